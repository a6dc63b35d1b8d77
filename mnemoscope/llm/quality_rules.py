"""Quality rules with thresholds learnt per language and source.

Each document gets counts of words, characters, symbols, repeated lines and
repeated five-word windows, and from them four ratios in millionths (integers, so
that every engine and every order of summing agrees).  The distribution of each
ratio in each (language, source) is kept as a mergeable quantile sketch: a
log-linear histogram (as in HDR histograms) whose bucket is the number's binary
length and its leading bits, so a quantile is right to one part in 32.  Sketches
merge by adding counts: partitions by Spark's partial aggregation, groups of
fewer than ``MIN_GROUP`` documents into their language's, and those into the whole.

A document fails a rule if its ratio lies further than ``SPREAD`` times the
interquartile range outside the quartiles of its group.  A ratio that is the same
number for more than half of a group (most documents have no symbols and repeat
nothing) has no such range; there the limit is the group's own ``TAIL`` quantile, so
at most the rest of 1 can fail.  No limit is a fixed number.  Documents of fewer than
``MIN_WORDS`` words have ratios too coarse to judge and are left to the base rule.
Thresholds are joined back to the documents; their table has a row for each
(language, source), and adaptive execution broadcasts it only if it is small.

Edge cases: null or empty texts have no words and fail the base rule.  Null
languages or sources form groups of their own.  Repeated rows count each time.
A ratio that ties with its limit passes.  Very long texts are counted whole, each as a slice of
its own.  An empty table gives an empty table.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .session import prepare

SPREAD = 5
TAIL = 95  # per cent
MIN_GROUP = 200
MIN_WORDS = 10
SUB_BITS = 5
#: The rules, and whether low values fail too.
RULES = {"symbols": False, "repeats": False, "dup_lines": False, "word_length": True}
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def counts_of(piece: tx.Slice) -> dict[str, np.ndarray]:
    """The base counts of each text of a slice, and its lines with a word."""
    words, n, data = tx.Words(piece), len(piece), piece.data
    starts = words.inside & ((data & 0xC0) != 0x80)  # first bytes of characters in words
    total = lambda mask: np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[piece.bounds])
    # Windows of five words found twice or more in one text.
    at, value = words.grams(5)
    own = tx.mix(value ^ (words.row[at].astype(tx.U64) * tx.U64(0x9E3779B97F4A7C15)))
    _, which, times = np.unique(own, return_inverse=True, return_counts=True)
    at = at[times[which] > 1]
    m = len(words.row) + 1
    covered = np.cumsum(np.bincount(at, minlength=m) - np.bincount(at + 5, minlength=m))[:-1] > 0
    # Lines with a word that equal an earlier line of their text.
    breaks = np.flatnonzero(data == 0x0A)
    start = np.sort(np.concatenate([piece.bounds[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, piece.bounds[1:]]))
    row = np.searchsorted(piece.bounds[1:], start, "right")
    some = (np.searchsorted(words.start, start) < np.searchsorted(words.start, end)) & (row < n)
    start, end, row = start[some], end[some], row[some]
    line = tx.mix(words.stretches(start, end) ^ (row.astype(tx.U64) * tx.U64(0x9E3779B97F4A7C15)))
    _, first = np.unique(line, return_index=True)
    lines = np.bincount(row, minlength=n)
    dup = lines - np.bincount(row[first], minlength=n)
    return {"n_words": words.count.astype(np.int64), "word_chars": total(starts), "n_symbols": total(_SYMBOL[data]), "n_dup_lines": dup, "n_repeat_words": np.bincount(words.row[covered], minlength=n), "n_lines": lines}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, piece in tx.slices(batch):
            got = counts_of(piece)
            yield pa.RecordBatch.from_arrays([part.column(x) for x in ("doc_id", "lang", "source")] + [pa.array(got[x], pa.int64()) for x in _COUNTS], names=["doc_id", "lang", "source", *_COUNTS])


def document_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, the five base counts and n_lines) for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return docs.mapInArrow(_count, "doc_id long, lang string, source string, " + ", ".join(f"{x} long" for x in _COUNTS))


def ratios() -> dict[str, Column]:
    """Each rule's ratio in millionths; n_words is above 0 where they are used."""
    million = lambda a, b: F.expr(f"{a} * 1000000L div {b}")
    return {"symbols": million("n_symbols", "word_chars"), "repeats": million("n_repeat_words", "n_words"), "dup_lines": million("n_dup_lines", "n_lines"), "word_length": million("word_chars", "n_words")}


def _shift(x: Column) -> Column:
    return F.greatest(F.length(F.bin(x)) - (SUB_BITS + 1), F.lit(0))


def bucket(x: Column) -> Column:
    """The least number that shares x's binary length and its leading SUB_BITS + 1 bits."""
    return F.call_function("shiftleft", F.call_function("shiftright", x, _shift(x)), _shift(x))


def bucket_end(x: Column) -> Column:
    """The largest number of the bucket that begins with x."""
    return x + F.call_function("shiftleft", F.lit(1).cast("long"), _shift(x)) - 1


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, level, rule, bucket, n): sketches of each (lang, source), each lang (level 1) and the whole (level 2)."""
    rule = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("v")) for k, v in ratios().items()))).alias("x")
    each = counts.where(F.col("n_words") >= MIN_WORDS).select("lang", "source", rule)
    base = each.groupBy("lang", "source", F.col("x.rule").alias("rule"), bucket(F.col("x.v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    by_lang = base.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    whole = by_lang.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    return (
        base.select("lang", "source", F.lit(0).alias("level"), "rule", "bucket", "n")
        .union(by_lang.select("lang", none, F.lit(1), "rule", "bucket", "n"))
        .union(whole.select(none, none, F.lit(2), "rule", "bucket", "n"))
    )


_QUANTILES = {"q1": 25, "q3": 75, "low_tail": 100 - TAIL, "high_tail": TAIL}


def quantiles(sketch: DataFrame) -> DataFrame:
    """(lang, source, level, rule, total, q1, q3, low_tail, high_tail): the first buckets at which so many per cent are reached."""
    group = Window.partitionBy("lang", "source", "level", "rule")
    reached = sketch.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("total"))
    at = [F.min(F.when(F.col("upto") * 100 >= F.col("total") * k, F.col("bucket"))).alias(name) for name, k in _QUANTILES.items()]
    return reached.groupBy("lang", "source", "level", "rule").agg(F.max("total").alias("total"), *at)


def thresholds(counts: DataFrame) -> DataFrame:
    """(lang, source, and low_ and high_ of each rule) for each (lang, source) of ``counts``."""
    q = quantiles(sketches(counts)).checkpoint()
    own = q.where("level = 0")
    lang = q.where("level = 1").select(F.col("lang").alias("l1"), F.col("rule").alias("r1"), *(F.col(x).alias(f"{x}_1") for x in ("total", *_QUANTILES)))
    whole = q.where("level = 2").select(F.col("rule").alias("r2"), *(F.col(x).alias(f"{x}_2") for x in _QUANTILES))
    joined = own.join(lang, (F.col("rule") == F.col("r1")) & F.col("lang").eqNullSafe(F.col("l1"))).join(whole, F.col("rule") == F.col("r2"))
    pick = lambda x: F.when(F.col("total") >= MIN_GROUP, F.col(x)).when(F.col("total_1") >= MIN_GROUP, F.col(f"{x}_1")).otherwise(F.col(f"{x}_2"))
    picked = joined.select("lang", "source", "rule", *(pick(x).alias(x) for x in _QUANTILES))
    spread = (F.col("q3") - F.col("q1")) * SPREAD
    low = F.when(spread > 0, F.col("q1") - spread).otherwise(F.col("low_tail"))
    high = F.when(spread > 0, F.col("q3") + spread).otherwise(bucket_end(F.col("high_tail")))
    limits = picked.select("lang", "source", "rule", low.alias("low"), high.alias("high"))
    limit = lambda name, rule: F.max(F.when(F.col("rule") == rule, F.col(name))).alias(f"{name}_{rule}")
    return limits.groupBy("lang", "source").agg(*(limit(name, rule) for rule in RULES for name in ("low", "high")))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, base counts, n_lines, base_failed, kept, failed) for each row of ``docs`` (doc_id, text, lang, source)."""
    prepare(docs.sparkSession)
    counts = document_counts(docs).checkpoint()
    limits = thresholds(counts)
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(x for x in limits.columns if x not in ("lang", "source")))
    ratio = ratios()
    fails = [
        F.when((ratio[k] > F.col(f"high_{k}")) | (F.lit(low) & (ratio[k] < F.col(f"low_{k}"))), F.lit(k))
        for k, low in RULES.items()
    ]
    failed = F.when(F.col("n_words") >= MIN_WORDS, F.concat_ws(",", *fails)).otherwise("")
    return (
        counts.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
        .select("doc_id", *_COUNTS, base_failed().alias("base_failed"), failed.alias("failed"))
        .select("*", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"))
    )
