"""Spelling variants: words at distance one, by permuterm rotations.

A word stands with a terminator behind it, and so does each of its rotations: for
``cat`` these are ``cat$``, ``at$c``, ``t$ca`` and ``$cat``.  If two words differ in
one replaced character, turn both until that character is last: what stands before
it is the same.  If one lacks a character of the other, its own whole rotation is what
stands before it.  So the rotations are sorted by that prefix, which skips the edited
character, and equal prefixes form a group: the words that have one more character
there, and at most one word that has none.

A group is never larger than the alphabet (90 letters and the word without), so it
is scanned, not multiplied out: each word of a group is near all others in it, and the best of the others is
the group's first or, for that one, its second.  Replacements fall into exactly one
group.  A character of a run, as in ``aab``, could be taken out at several places;
only the last of the run counts, so that each pair of words meets once.  A word's groups are
then added up: number of near words, and the best of them.

Rows of rotations are a prefix, a character and a count: the word is put together again
where it is near another.  Words follow their forms to the last by doubling: each round joins
the forms with themselves; as a form is ten times as frequent as its word, five rounds are
enough for any count below 2**63.

Edge cases: a null or empty text has no words; a null id reads as empty in the place of
a number.  Very long texts are worked on whole.  Repeated rows count as often as they stand; ties go
by code point.  Other columns are not read.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import prepare

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "A-Za-zÀ-ÿ"
#: Shortest words that are looked at, least occurrences, and how much more frequent a form must be.
LENGTH, OCCURRENCES, TIMES = 7, 2, 10
#: One run in so many loses a character.
NOISE = 31
END = "$"


def noisy_words(docs: DataFrame) -> DataFrame:
    """(word): every run of letters of ``docs`` (doc_id, text) that can be a word, with the made-up slips of ``NOISE``."""
    # Runs lose at most one character, so shorter ones need not leave the text.
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LENGTH},}}"), F.lit(0))).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, UPPER.lower())).otherwise(F.col("run"))
    hashed = runs.select("doc_id", lower.alias("run")).select("run", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slip = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % NOISE == 0, slip).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LENGTH)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, edit, n) of ``words`` (word, n): each rotation without its last character, and whole with an empty ``edit``."""
    w, size = F.col("word"), F.length("word")
    turned = lambda i, upto: F.concat(w.substr(i + 1, size), F.lit(END), w.substr(F.lit(1), upto))
    skipping = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(turned(i, i - 1).alias("prefix"), w.substr(i, F.lit(1)).alias("edit")))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(turned(i, i).alias("prefix"), F.lit("").alias("edit")))
    return words.select("n", F.explode(F.concat(skipping, whole)).alias("r")).select("r.prefix", "r.edit", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): how many words of ``words`` (word, n; each once) are near, and the most frequent of them; words with none are left out."""
    group, edit = Window.partitionBy("prefix"), F.col("edit")
    whole = edit == ""
    ordered = group.orderBy(whole, F.col("n").desc(), "edit")
    # A negative count puts the most frequent first, and of equals the least in code points.
    rank = lambda condition: F.when(condition, F.struct((-F.col("n")).alias("n"), edit.alias("edit")))
    last_of_run = ~whole & (edit != F.col("prefix").substr(1, 1))
    scanned = rotations(words).select(
        "prefix", "edit", whole.alias("whole"), last_of_run.alias("counts"),
        F.count(F.when(~whole, 1)).over(group).alias("n_edits"), F.count(F.when(last_of_run, 1)).over(group).alias("n_counting"),
        F.max(F.when(whole, F.col("n"))).over(group).alias("whole_n"), F.min(rank(last_of_run)).over(group).alias("counting"),
        F.first(rank(~whole)).over(ordered).alias("first"), F.lead(rank(~whole)).over(ordered).alias("second"), F.row_number().over(ordered).alias("place"),
    )
    shorter = F.col("counts") & F.col("whole_n").isNotNull()
    near = F.when(F.col("whole"), F.col("n_counting")).otherwise(F.col("n_edits") - 1 + shorter.cast("long"))
    behind, before = (F.substring_index("prefix", END, k) for k in (1, -1))
    word = lambda e: F.concat(before, e, behind)
    found = lambda x: F.when(x.isNotNull(), F.struct(x["n"].alias("n"), word(x["edit"]).alias("word")))
    other = found(F.when(F.col("whole"), F.col("counting")).when(F.col("place") == 1, F.col("second")).otherwise(F.col("first")))
    without = F.when(shorter, F.struct((-F.col("whole_n")).alias("n"), word(F.lit("")).alias("word")))
    per_group = scanned.where(near > 0).select(word(F.col("edit")).alias("word"), near.alias("near"), F.least(other, without).alias("best"))
    return per_group.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form; each word once, no circles): the last form reached from each word."""
    reached = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).checkpoint()
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def best_form(best_n: Column, best: Column, n: Column) -> Column:
    return F.when(best_n >= TIMES * n, best)


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text) that is long and frequent enough."""
    prepare(docs.sparkSession)
    words = noisy_words(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OCCURRENCES).checkpoint()
    near = neighbours(words)
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        best_form(F.col("best_n"), F.col("best"), F.col("n")).alias("form"), best_form(F.col("best_n"), F.col("best_n"), F.col("n")).alias("form_n"),
    ).checkpoint()
    last = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
