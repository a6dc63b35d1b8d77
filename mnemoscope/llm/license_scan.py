"""License scan: Aho-Corasick for notices and tags, shunting-yard for expressions.

A text is lower-cased (ASCII) and reduced to its words, joined by one space and
with a space at either end; one Aho-Corasick pass over that finds every notice
phrase at word boundaries, overlapping ones included.  A second automaton finds
identifier tags in the lower-cased text; the licence expression after a tag, as far
as it goes in that line (prose behind it gives no labels), is evaluated by a shunting-yard parser with the
operators ``with`` (binds first), ``and`` and ``or``.

Labels are those of base phrases, of further notice phrases and of identifiers
in expressions.  The score says how freely a text may be used, from 0 (nothing
found) to 1: each label has a value, all notices hold together (the least value
counts), and in expressions ``and`` takes the least, ``or`` the largest and
``with`` adds half of what the licence lacks.  An expression that can't be
parsed counts its known identifiers as if joined by ``and``.

Edge cases: null texts read as empty, with no words, places or labels, null
first_word and last_word, and score 0.  Very long texts are scanned whole.
Repeated rows and ties are rows of their own.  Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import prepare

#: Phrases of the base contract and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices; words as in BASE_PHRASES.
NOTICE_PHRASES = {
    "lesser general public license": "lgpl", "affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "bsd license": "bsd", "isc license": "isc", "boost software license": "bsl", "creative commons attribution": "cc-by", "cc by": "cc-by", "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "public domain": "public-domain", "all rights reserved": "proprietary",
    "redistribution and use in source and binary forms": "bsd", "permission is hereby granted free of charge": "mit",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: How freely a label's texts may be used.
VALUES = {
    "public-domain": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "bsl": 0.95, "apache": 0.9, "cc-by": 0.85, "mpl": 0.7, "epl": 0.65, "lgpl": 0.6,
    "cc-by-sa": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.25, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.15, "proprietary": 0.05,
}
#: Identifier beginnings and their labels; the longest that fits counts.
IDENTIFIERS = {
    "mit": "mit", "isc": "isc", "bsd": "bsd", "0bsd": "bsd", "bsl": "bsl", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl",
    "cc0": "public-domain", "unlicense": "public-domain", "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc-by-nc-sa": "cc-by-nc-sa",
}
_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")
_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_LOWER_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def identifier_label(token: str) -> str | None:
    """The label of the longest identifier that ``token`` is or begins with, before a dash or digit."""
    fits = [k for k in IDENTIFIERS if token == k or token.startswith(k) and token[len(k)] in "-+.0123456789"]
    return IDENTIFIERS[max(fits, key=len)] if fits else None


def evaluate(expression: str) -> tuple[set[str], float]:
    """(labels, score) of the licence expression that ``expression`` begins with; see the module's docstring for the rules."""
    labels: set[str] = set()  # of the tokens that the parser took
    output: list[float | None] = []  # values of what was read
    operators: list[str] = []

    def apply(op: str) -> None:
        right, left = output.pop(), output.pop()
        if op == "with":
            output.append(left + (1 - left) / 2 if left else 0.0)
        else:
            output.append((min if op == "and" else max)(left, right))

    def reduce_to(least: int) -> None:
        while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= least:
            apply(operators.pop())

    expects, sound = True, True
    for match in _TOKEN.finditer(expression):
        t = match[0]
        if t in _BINDS:
            if expects:
                sound = False
                break
            reduce_to(_BINDS[t])
            operators.append(t)
            expects = True
        elif t == "(":
            if not expects:
                break  # prose follows the expression
            operators.append(t)
        elif t == ")":
            if expects or "(" not in operators:
                sound = not expects
                break
            reduce_to(0)
            operators.pop()
        else:
            if not expects:
                break
            label = None if operators and operators[-1] == "with" else identifier_label(t)  # an exception is no licence
            if label:
                labels.add(label)
            output.append(VALUES.get(label, 0.0))
            expects = False
    if not expects and sound:
        reduce_to(0)
    if expects or not sound or operators or len(output) != 1:
        return labels, min((VALUES[x] for x in labels), default=0.0)
    return labels, output[0]


def _automaton(words) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


class Scanner:
    def __init__(self):
        self.phrases = _automaton(f" {p} " for p in (BASE_PHRASES | NOTICE_PHRASES))
        self.tags = _automaton(TAGS)

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.translate(_WORD_BYTES).split()
        # Each byte becomes one character, so that the automaton works on compact strings.
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        base, labels, notices, starts = set(), set(), [], []
        for end, phrase in self.phrases.iter(joined):
            name = phrase[1:-1]
            if name in BASE_PHRASES:
                base.add(BASE_PHRASES[name])
                starts.append(end - len(phrase) + 1)
            notices.append(BASE_PHRASES.get(name) or NOTICE_PHRASES[name])
        first = last = None
        if starts:
            first = joined.count(" ", 0, min(starts))
            last = joined.count(" ", 0, max(starts))
        scores = [VALUES[x] for x in notices]
        labels |= base | set(notices)
        lower = raw.translate(_LOWER_BYTES)
        if any(t.encode() in lower for t in TAGS):
            line_text = lower.decode("latin-1")
            for end, _ in self.tags.iter(line_text):
                stop = line_text.find("\n", end)
                found, score = evaluate(line_text[end + 1 : stop if stop >= 0 else len(line_text)])
                if found:
                    labels |= found
                    scores.append(score)
        return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=0.0)


_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            found = list(zip(*(scanner.scan(t.as_py()) for t in part.column("text")), strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, t) for x, t in zip(found, _TYPES, strict=True))], names=["doc_id", *_NAMES])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
