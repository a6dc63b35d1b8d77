"""Secret scan over an incremental ledger of blobs, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content, its blob.
The ledger says which (blob, rule, rule version) pairs have been scanned and what
was found; a run scans only pairs that it doesn't hold, each distinct blob once,
and joins findings back to all paths and versions.  A rule whose version changes
is scanned again, for all blobs, and no other is.

Positions come from lengths: the parts between matches (``split``) and the
matches (``regexp_extract_all``) alternate, so a match begins at the running sum
of both.  That sum is a window over the matches of one blob and rule.  A cheap
alternation first rules out texts without any trigger.

``LedgerTable`` keeps the ledger as Parquet, so that later runs scan only what is new.

Edge cases: null texts read as empty.  A blob in a third of all versions is one
row after map-side aggregation.  Rules find leftmost, non-overlapping matches
per rule; matches whose secret is too short are dropped after matching.  Null ids
and repeated rows each keep their row.  Spans that begin together go by the order of the rules.
Very long texts are scanned whole; an empty table leaves an empty ledger.  Extra columns are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import prepare, unused_names


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    group: int = 0  # the group that holds the secret
    least: int = 0  # and its least length
    base: bool = False


_BEGIN, _END = (rf"-----{x} [A-Z ]{{0,20}}PRIVATE KEY-----" for x in ("BEGIN", "END"))
#: What follows a key's header: all up to its end mark, or, without one, lines and long runs of base64 (line ends may be
#: escaped, as in JSON).  Possessive, so Java neither recurses nor backtracks on long texts.
_TO_END = rf"[^-]*+(?:-(?!----)[^-]*+)*+{_END}"
_BASE64 = r"(?:(?:[\x20\x09-\x0D]|\\[nr])++(?:(?:Proc-Type|DEK-Info):[^\r\n]*+|[A-Za-z0-9+/=]{16,}+|[A-Za-z0-9+/=]++(?=[\x20\x09]*+(?:[\r\n]|\\[nr]|$))))*+"
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, base=True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, base=True),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, base=True),
    Rule("private_key", 2, f"{_BEGIN}(?:{_TO_END}|{_BASE64})"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", 2, r"://[^\x20\x09-\x0D/:@]++:[^\x20\x09-\x0D/:@]++@"),
)
#: Every match of a rule contains a match of this.
TRIGGER = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{24}|PRIVATE KEY-----|gh[pousr]_|xox[abprs]-|eyJ|://[^\x20\x09-\x0D/:@]++:"
REDACTED = "[SECRET]"


def blob_id(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def unseen_blobs(versions: DataFrame, scanned: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, done): distinct blobs of ``versions`` with a rule that is still to be run; ``done`` lists the others."""
    key = F.concat_ws("@", "rule", F.col("version").cast("string"))
    names = [f"{r.name}@{r.version}" for r in rules]
    blobs = versions.groupBy(blob_id().alias("blob")).agg(F.any_value(F.coalesce("text", F.lit(""))).alias("text"))
    if scanned is None:
        return blobs.select("blob", "text", F.lit(None).cast("array<string>").alias("done"))
    done = scanned.select(F.col("blob").alias("b"), key.alias("k")).where(F.col("k").isin(names)).groupBy("b").agg(F.collect_set("k").alias("done"))
    return blobs.join(done, F.col("blob") == F.col("b"), "left").where(F.coalesce(F.size("done"), F.lit(0)) < len(names)).select("blob", "text", "done")


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, version, start, end) of every match in ``blobs`` (blob, text, done); positions in code points, end exclusive."""
    text = F.col("text")

    def matches(r: Rule) -> Column:
        lengths = F.transform(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)), F.length)
        secret = F.transform(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group)), F.length) if r.group else lengths
        gaps = F.transform(F.split(text, r.pattern, -1), F.length)
        all_three = F.arrays_zip(F.slice(gaps, 1, F.size(lengths)).alias("gap"), lengths.alias("length"), secret.alias("secret"))
        todo = F.col("done").isNull() | ~F.array_contains("done", f"{r.name}@{r.version}")
        # Gaps and groups only where something was found; most texts are scanned once for a rule.
        todo = todo & (F.size(lengths) > 0)
        return F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), F.when(todo, all_three).alias("found"))

    order = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = blobs.where(text.rlike(TRIGGER)).select("blob", F.explode(F.array(*map(matches, rules))).alias("x"))
    each = each.select("blob", "x.rule", "x.version", "x.least", F.posexplode("x.found").alias("at", "m"))
    placed = each.select("blob", "rule", "version", "least", "m.length", "m.secret", F.sum(F.col("m.gap") + F.col("m.length")).over(order).alias("end"))
    return placed.where("secret >= least").select("blob", "rule", "version", (F.col("end") - F.col("length")).alias("start"), "end")


@dataclass(frozen=True)
class Ledger:
    """What is known of blobs: pairs that were scanned, and findings."""

    scanned: DataFrame  # blob, rule, version
    findings: DataFrame  # blob, rule, version, start, end


def scan_unseen(versions: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> Ledger:
    """New entries only: the pairs of ``versions`` (text) that ``ledger`` doesn't hold, and what they found."""
    prepare(versions.sparkSession)
    scanned = ledger.scanned if ledger else None
    found = find(unseen_blobs(versions, scanned, rules), rules)
    pairs = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))).alias("p")
    new = versions.select(blob_id().alias("blob")).distinct().select("blob", pairs).select("blob", "p.rule", "p.version")
    if scanned is not None:
        new = new.join(scanned.select("blob", "rule", "version").distinct(), ["blob", "rule", "version"], "left_anti")
    return Ledger(new, found)


def update(versions: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> Ledger:
    """The ledger after ``versions`` (text): earlier entries, and those of unseen pairs."""
    new = scan_unseen(versions, ledger, rules)
    new = Ledger(new.scanned, new.findings.checkpoint())
    return new if ledger is None else Ledger(ledger.scanned.select(*new.scanned.columns).union(new.scanned), ledger.findings.select(*new.findings.columns).union(new.findings))


@dataclass(frozen=True)
class LedgerTable:
    """A ledger kept as Parquet in a shared folder, a subfolder for each run.

    A run writes its findings, then its pairs; it counts once the pairs are complete
    (Spark's success mark), so a run that was cut short is as if it had not been.
    """

    spark: SparkSession
    folder: str

    def _runs(self) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/*/scanned/_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(x.getPath().getParent().getParent().toString() for x in found or [])

    def load(self) -> Ledger | None:
        runs = self._runs()
        if not runs:
            return None
        read = lambda part, schema: self.spark.read.schema(schema).parquet(*(f"{r}/{part}" for r in runs))
        return Ledger(read("scanned", "blob string, rule string, version int"), read("findings", "blob string, rule string, version int, start long, end long"))

    def append(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> Ledger:
        """Scan what is unseen of ``versions``, write it as a run, and give the whole ledger."""
        new = scan_unseen(versions, self.load(), rules)
        run = f"{self.folder}/run-{len(self._runs()):06d}-{uuid.uuid4().hex}"
        new.findings.selectExpr("blob", "rule", "version", "cast(start as long) start", "cast(end as long) end").write.parquet(f"{run}/findings")
        new.scanned.write.parquet(f"{run}/scanned")
        return self.load()


def _rank(rules: tuple[Rule, ...]) -> Column:
    return reduce(lambda rest, x: F.when(F.col("rule") == x[1].name, x[0]).otherwise(rest), enumerate(rules), F.lit(len(rules)))


def by_version(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_ of each base rule, base_spans, spans) for each row of ``versions`` (doc_id, text)."""
    current = reduce(lambda a, b: a | b, ((F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules))
    base = [r.name for r in rules if r.base]
    ordered = F.array_sort(F.collect_list(F.struct("start", "rank", "rule", "end")))
    found = ledger.findings.where(current).select("*", _rank(rules).alias("rank")).groupBy("blob").agg(ordered.alias("all"))
    as_text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda name: F.coalesce(F.size(F.filter("all", lambda x: x["rule"] == name)), F.lit(0)).cast("long").alias(f"n_{name}")
    counts = [F.when(F.col("all").isNull(), 0).otherwise(count(n)).cast("long").alias(f"n_{n}") for n in base]
    paths = versions.select("doc_id", blob_id().alias("path_blob"))
    return paths.join(found, F.col("path_blob") == F.col("blob"), "left").select(
        "doc_id", *counts,
        F.coalesce(as_text(F.filter("all", lambda x: x["rule"].isin(base))), F.lit("")).alias("base_spans"),
        F.coalesce(as_text(F.col("all")), F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, ledger: Ledger, replacement: str = REDACTED) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced, overlapping spans as one; n_chars, if there, follows the text."""
    key, blob, spans = unused_names(docs, "key", "blob", "spans")
    before = Window.partitionBy("blob").orderBy("start", "end")
    islands = (
        ledger.findings.select("blob", "start", "end").distinct()
        .select("*", F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("reach"))
        .select("blob", "start", "end", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
        .groupBy("blob", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans))
    )
    kept_parts = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.col("text").substr(
            (F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"]) + 1).cast("int"),
            (F.coalesce(F.get(spans, i)["start"], F.length("text").cast("long")) - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])).cast("int"),
        ),
    )
    joined = docs.withColumn(key, blob_id()).join(islands, F.col(key) == F.col(blob), "left")
    clean = joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(kept_parts, replacement)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select(*docs.columns)
