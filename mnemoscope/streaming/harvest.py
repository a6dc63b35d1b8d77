"""Harvest: take in what lies in an inbox, give vectors to texts that have none, and put the files away.

A run reads new files as a stream that stops when all are read, ``foreachBatch`` by ``foreachBatch``:

1. lines become observations (bad ones are counted), named by batch and place, and are written as that batch;
2. texts whose content has no vector of the model yet are found by a left-anti join on (model, content hash), each text once;
3. a receipt is written, with counts by label and the batch's files.

All three are written under the batch's number.  If a run is killed, the stream's checkpoint gives the same files
the same number again and the batch is written anew, so each row is there once.  Files go to the archive
after their receipt is complete; those left behind by a killed run go with the next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import label_of, parse_importance, unit
from ..functions.text import kind_of, once, text_vector
from ..sources import readers
from ..sources.batches import BatchTable

OBSERVATION = "id string, ts timestamp, kind string, tool_name string, summary string, summary_en string, lang string, scope string, detail string, importance double, label string, hash string"
VECTOR = "model string, hash string, dim int, vector array<double>, norm double"
RECEIPT = "batch long, seen long, inserted long, bad long, embedded long, labels map<string,long>, files array<string>"
#: Keys of an observation that are columns; all others belong to its detail. Fixed values.
KNOWN = ("ts", "kind", "summary", "summary_en", "text_en", "lang", "tool_name", "tool", "detail", "detail_json")


def merged_detail(line: Column) -> Column:
    """The detail of a JSON line as JSON: its own object (given as such or as text), and over it all keys that are no columns; keys in order."""
    def own_keys(given: Column) -> Column:
        is_text = F.schema_of_variant(given) == "STRING"
        body = F.when(is_text, F.try_variant_get(given, "$", "string")).otherwise(F.to_json(given))
        held = once(body, lambda b: F.from_json(F.when(F.schema_of_variant(F.try_parse_json(b)).startswith("OBJECT"), b), "map<string,variant>"))
        other = F.map_from_arrays(F.array(F.when(is_text, "_raw_detail").otherwise("_detail")), F.array(given))
        return F.when(given.isNull(), None).otherwise(F.coalesce(held, other))

    def merged(own: Column, extra: Column) -> Column:
        kept = once(F.map_keys(extra), lambda names: F.map_filter(own, lambda k, v: ~F.array_contains(names, k)))
        return F.coalesce(F.map_concat(kept, extra), extra)

    def in_order(both: Column) -> Column:
        by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both), by_key)))

    def of(top: Column) -> Column:
        own = once(F.coalesce(top["detail"], top["detail_json"]), own_keys)
        extra = F.map_filter(top, lambda k, v: ~k.isin(*KNOWN))
        return once(own, lambda o: once(extra, lambda e: once(merged(o, e), in_order)))

    return once(F.from_json(line, "map<string,variant>"), of)


def content_hash(text: Column) -> Column:
    return F.sha2(F.trim(text).cast("binary"), 256)


def observations(lines: DataFrame) -> DataFrame:
    """OBSERVATION's columns but for ``id`` of ``lines`` (line, detail, error), as ``readers.observation_lines`` gives them."""
    rows = readers.normalised(lines.withColumn("merged", merged_detail(F.col("line"))), keep=("merged",))
    rows = rows.withColumn("importance", _importance(F.col("merged")))
    importance = F.col("importance")
    return rows.select(
        "ts", kind_of(F.col("summary"), F.col("kind")).alias("kind"), "tool_name", "summary", "summary_en", "lang", "scope", F.col("merged").alias("detail"), "importance",
        label_of(importance).alias("label"), content_hash(F.col("summary")).alias("hash"),
    )


def _importance(detail: Column) -> Column:
    said = lambda v: F.coalesce(F.try_variant_get(v, "$.importance.score", "string"), F.try_variant_get(v, "$.importance", "string"))
    return once(once(F.try_parse_json(detail), said), parse_importance)


def without_vectors(rows: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(hash, text) of ``rows`` (hash, text) with words but no vector of ``model``, each content once."""
    own = vectors.where(F.col("model") == model).select("hash").distinct()
    return rows.where(F.trim("text") != "").join(own, "hash", "left_anti").dropDuplicates(["hash"]).select("hash", "text")


def embedded(todo: DataFrame, model: str, embed: Callable[[Column], Column]) -> DataFrame:
    """VECTOR's rows for ``todo`` (hash, text)."""
    vector = embed(F.col("text"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return todo.select(F.lit(model).alias("model"), "hash", vector.alias("vector")).select("model", "hash", F.size("vector").alias("dim"), "vector", norm.alias("norm"))


def receipt(batch: int, rows: DataFrame, bad: DataFrame, n_embedded: int, files: DataFrame) -> DataFrame:
    """One row that says what a batch brought."""
    labels = rows.groupBy(F.coalesce("label", F.lit("unknown")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    counts = labels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inserted"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    names = files.distinct().agg(F.array_sort(F.collect_list("file")).alias("files"))
    return counts.crossJoin(bad.agg(F.count(F.lit(1)).alias("bad"))).crossJoin(names).select(
        F.lit(batch).cast("long").alias("batch"), (F.col("inserted") + F.col("bad")).alias("seen"), "inserted", "bad", F.lit(n_embedded).cast("long").alias("embedded"), "labels", "files"
    )


@dataclass(frozen=True)
class Store:
    """Observations, vectors and receipts below one folder."""

    spark: SparkSession
    folder: str

    def table(self, name: str, schema: str) -> BatchTable:
        return BatchTable(self.spark, f"{self.folder}/{name}", schema)

    @property
    def observations(self) -> BatchTable:
        return self.table("observations", OBSERVATION)

    @property
    def vectors(self) -> BatchTable:
        return self.table("vectors", VECTOR)

    @property
    def receipts(self) -> BatchTable:
        return self.table("receipts", RECEIPT)

    def take_in(self, lines: DataFrame, batch: int, *, model: str, embed: Callable[[Column], Column] | None) -> None:
        """Write one batch of ``lines`` (value, file); writing it again changes nothing."""
        parsed = readers.parsed_lines(lines)
        rows = observations(parsed).withColumn("id", F.concat_ws("-", F.lit(str(batch)), F.monotonically_increasing_id().cast("string")))
        self.observations.write(rows.select([c.split()[0] for c in OBSERVATION.split(", ")]), batch)
        written = self.spark.read.schema(OBSERVATION).parquet(f"{self.observations.folder}/batch-{batch:09d}")
        n = 0
        if embed is not None:
            todo = without_vectors(written.select("hash", F.col("summary").alias("text")), self.vectors.read(before=batch), model)
            self.vectors.write(embedded(todo, model, embed), batch)
            n = self.spark.read.schema(VECTOR).parquet(f"{self.vectors.folder}/batch-{batch:09d}").count()
        self.receipts.write(receipt(batch, written, parsed.where("error"), n, lines.select("file")).coalesce(1), batch)

    def archive(self, folder: str) -> int:
        """Move files that a receipt names to ``folder``; those that have gone already are passed over."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(path(folder))
        moved = 0
        for (name,) in self.receipts.read().select(F.explode("files")).toLocalIterator():
            if files.exists(path(name)):
                moved += files.rename(path(name), path(folder, path(name).getName()))
        return moved


def harvest(
    spark: SparkSession, inbox: str, store: str, *, archive: str | None = None, model: str = "hashed-words", embed: Callable[[Column], Column] | None = text_vector, files_per_batch: int = 100
) -> DataFrame:
    """Take in all files of ``inbox`` (JSON lines) that were not read before; the receipts of all batches.

    ``embed`` turns a text column into a vector column; None leaves vectors out.  Texts of equal content share a vector.
    """
    own = Store(spark, store)
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(inbox).select("value", F.col("_metadata.file_path").alias("file"))

    def batch(rows: DataFrame, number: int) -> None:
        own.take_in(rows, number, model=model, embed=embed)

    lines.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start().awaitTermination()
    if archive is not None:
        own.archive(archive)
    return own.receipts.read()


def remember(requests: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each of ``requests`` (text, category, importance, scope): the observation to append, its Markdown line, or the error.

    Columns: those of ``keep``, error ("empty text" or null), kind, summary, importance, label, scope, hash, markdown.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    score = unit(F.col("importance").cast("double"))
    kind, label = kind_of(text, F.col("category")), label_of(score)
    line = F.concat(F.lit("- ["), F.upper(kind), F.lit("] "), text, F.lit(" (importance: "), F.format_string("%.2f", score), F.lit(", "), label, F.lit(")"))
    ok = text != ""
    return requests.select(
        *keep, F.when(~ok, "empty text").alias("error"), F.when(ok, kind).alias("kind"), F.when(ok, text).alias("summary"), F.when(ok, score).alias("importance"), F.when(ok, label).alias("label"),
        F.nullif(F.trim("scope"), F.lit("")).alias("scope"), F.when(ok, content_hash(text)).alias("hash"), F.when(ok, line).alias("markdown"),
    )
