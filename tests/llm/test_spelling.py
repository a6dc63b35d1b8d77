"""Near words and their forms against all pairs."""

import random
import re
import zlib
from collections import Counter

from mnemoscope.llm import spelling


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    close = {w: [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if near(w, v)] for w in words}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(close[w]), words[form[w]] if w in form else None))
    return out


def got(df):
    rows = [tuple(r) for r in spelling.variants(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_texts():
    """Words with runs of a letter, slips of slips and accents, some far more frequent than others."""
    r = random.Random(2)
    stems = ["aaaaaaa", "bananana", "straßenbahn", "Éclatant", "keepsakes", "mississippi"]
    texts = []
    for k in range(400):
        words = []
        for stem in stems:
            word = stem
            while r.random() < 0.25:
                i = r.randrange(len(word) + 1)
                word = r.choice([word[:i] + r.choice("aénÀ÷") + word[i:], word[:i] + word[i + 1 :], word[:i] + r.choice("aésÉ") + word[i + 1 :]])
            words += [word] * r.choice([1, 1, 4]) * (word != "")
        texts.append((k if k % 50 else None, r.choice([" ", "-", "1", "\n"]).join(words)))
    return texts


def test_variants(spark):
    rows = some_texts()
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == plain_variants(rows)


def test_hard_rows(hard, hard_rows, nothing):
    assert got(hard) == plain_variants([(i, t) for i, t, *_ in hard_rows])
    assert spelling.variants(nothing).count() == 0


def test_documents(sf_docs):
    assert got(sf_docs) == plain_variants([(r.doc_id, r.text) for r in sf_docs.select("doc_id", "text").collect()])


def test_forms_are_followed_to_the_last(spark):
    """A chain of five forms, and a fork."""
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(6)] + [("x", "w3")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(chain).collect()} == {(f"w{i}", "w6") for i in range(6)} | {("x", "w6")}
