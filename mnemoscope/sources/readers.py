"""Readers with stated schemas: observation lines, topologies, runtime reports and Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language, nfkc, scope_token

OBSERVATION = "ts string, kind string, tool_name string, tool string, summary string, summary_en string, text_en string, lang string, detail string, detail_json string"


def observation_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines: ``line``, ``detail`` (a variant) and ``error`` for lines that aren't objects; blank lines go."""
    return parsed_lines(spark.read.text(path))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``observation_lines`` of lines (value) read already."""
    v = F.try_parse_json("value")
    return lines.where(F.trim("value") != "").select(F.col("value").alias("line"), v.alias("detail"), (v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT")).alias("error"))


def normalised(rows: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Observations in their common form: aliases folded, times parsed, language and scope filled in; columns of ``keep`` stay."""
    get = lambda *names: F.coalesce(*(F.try_variant_get("detail", f"$.{n}", "string") for n in names))
    summary = F.coalesce(get("summary"), F.lit(""))
    return rows.where(~F.col("error")).select(
        iso_time(get("ts")).alias("ts"), F.coalesce(F.nullif(F.trim(get("kind")), F.lit("")), F.lit("note")).alias("kind"), get("tool_name", "tool").alias("tool_name"), summary.alias("summary"),
        get("summary_en", "text_en").alias("summary_en"), F.coalesce(get("lang"), language(summary)).alias("lang"), scope_token(nfkc(get("detail.scope", "scope"))).alias("scope"), "detail", *keep,
    )


def iso_time(raw: Column) -> Column:
    """ISO-8601 with Z, an offset or none (then UTC); null if it can't be read."""
    t = F.regexp_replace(F.trim(raw), "[Zz]$", "+00:00")
    zoned = F.when(t.rlike(r"[+-]\d\d:?\d\d$"), t).otherwise(F.concat(t, F.lit("+00:00")))
    return F.try_to_timestamp(zoned)


def topology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON topology files; aliases from/source and to/target are understood."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    nodes = doc.select(F.explode(F.from_json(F.to_json(F.try_variant_get("v", "$.nodes", "variant")), "array<struct<id string, type string, tags array<string>>>")).alias("n"))
    edges = doc.select(F.explode(F.from_json(F.to_json(F.try_variant_get("v", "$.edges", "variant")), "array<map<string,string>>")).alias("e"))
    field = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col("e")[n]), F.lit("")) for n in names))
    return (
        nodes.select(F.trim("n.id").alias("node_id"), F.coalesce("n.type", F.lit("unknown")).alias("node_type"), F.array_sort(F.array_distinct(F.coalesce("n.tags", F.array().cast("array<string>")))).alias("tags")),
        edges.select(field("src", "from", "source").alias("src"), field("dst", "to", "target").alias("dst"), field("type").alias("type"), F.coalesce(field("provenance"), F.lit("")).alias("provenance")).where("src is not null and dst is not null"),
    )


def topology_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(issue, ref): ids given twice, edges given twice and ends that no node has."""
    twice = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_node").alias("issue"), F.col("node_id").alias("ref"))
    again = edges.groupBy("src", "dst", "type", "provenance").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_edge").alias("issue"), F.concat_ws(" ", "src", "dst", "type").alias("ref"))
    known = nodes.select(F.col("node_id").alias("k")).distinct()
    lost = lambda end: edges.join(known, F.col(end) == F.col("k"), "left_anti").select(F.lit(f"unknown_{end}").alias("issue"), F.col(end).alias("ref")).distinct()
    return twice.unionByName(again).unionByName(lost("src")).unionByName(lost("dst"))


def runtime_report(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, status, position) of runtime reports: a list, {nodes: [...]} or {status_by_node: {...}}."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.nodes", "variant"), F.col("v"))
    rows = doc.select(F.posexplode(F.from_json(F.to_json(listed), "array<struct<id string, status string>>")).alias("position", "n")).select(F.col("n.id").alias("node_id"), "n.status", "position")
    by_node = doc.select(F.explode(F.from_json(F.to_json(F.try_variant_get("v", "$.status_by_node", "variant")), "map<string,string>"))).select(F.col("key").alias("node_id"), F.col("value").alias("status"), F.lit(0).alias("position"))
    return rows.where("node_id is not null").unionByName(by_node)


def sections(markdown: str, max_chars: int = 1200) -> Iterator[tuple[str, str, int, str]]:
    """(heading path, title, ordinal, text) of chunks: paragraphs of a section packed up to ``max_chars``, headings in fences left alone."""
    limit, path, fenced, body, ordinal = max(200, max_chars), [], False, [], 0
    found: list[tuple[list[str], list[str]]] = [([], [])]
    for line in (markdown or "").split("\n"):
        fenced ^= line.lstrip().startswith("```")
        level = len(line) - len(line.lstrip("#"))
        if not fenced and 1 <= level <= 6 and line[level : level + 1] == " ":
            path = [*path[: level - 1], line[level:].strip()]
            found.append((path, []))
        else:
            found[-1][1].append(line)
    for path, lines in found:
        body, held = [p.strip() for p in "\n".join(lines).split("\n\n") if p.strip()], ""
        pieces = [p[i : i + limit] for p in body for i in range(0, len(p), limit)]
        for piece in [*pieces, None]:
            if held and (piece is None or len(held) + 2 + len(piece) > limit):
                yield " > ".join(path), path[-1] if path else "", ordinal, held
                held, ordinal = "", ordinal + 1
            if piece is not None:
                held = f"{held}\n\n{piece}" if held else piece


def markdown_chunks(docs: DataFrame, *, max_chars: int = 1200) -> DataFrame:
    """Chunks of ``docs`` (doc_id, text): doc_id, ordinal, heading_path, title, text, hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, n, h, t, x) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for h, t, n, x in sections(text, max_chars)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["doc_id", "ordinal", "heading_path", "title", "text"])

    chunks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, ordinal int, heading_path string, title string, text string")
    return chunks.withColumn("hash", F.sha1(F.concat_ws("\n", "heading_path", "title", "text").cast("binary")))


#: Marks of paragraphs that are left out, in any case, and the size of chunks. Fixed values.
DENY_MARKERS, CHUNK_CHARS = ("[SECRET]", "[PRIVATE]", "[NOEXPORT]", "[NOMEM]"), 1600


def workspace(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the Markdown files below ``folder``, whole; hidden files and folders are passed over, bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def paragraph_chunks(docs: DataFrame, *, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """(ordinal, text and all other columns) of ``docs`` (text and more): paragraphs packed in order up to ``max_chars``, one row for each chunk.

    Paragraphs end at blank lines. One with a mark of ``DENY_MARKERS`` is left out; a longer one than ``max_chars`` is cut, and its parts
    are chunks of their own. White space at ends is ASCII white space. A null or empty text has no chunk.
    """
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    kept = lambda x: (x != "") & ~F.upper(x).rlike("|".join(re.escape(m) for m in DENY_MARKERS))
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n", -1), strip), kept)
    none = F.array().cast("array<string>")

    def step(a: Column, x: Column) -> Column:
        held, size = a["held"], F.length(x)
        full = (held != "") & (F.length(held) + 2 + size + 2 > max_chars)
        done = F.when(full, F.array_append(a["done"], held)).otherwise(a["done"])
        before = F.when(full, F.lit("")).otherwise(held)
        pieces = F.filter(F.transform(F.sequence(F.lit(1), size, F.lit(max_chars)), lambda i: strip(x.substr(i, F.lit(max_chars)))), kept)
        joined = F.when(before == "", x).otherwise(F.concat(before, F.lit("\n\n"), x))
        long = size > max_chars
        return F.struct(F.when(long, F.concat(done, pieces)).otherwise(done).alias("done"), F.when(long, before).otherwise(joined).alias("held"))

    last = lambda a: F.when(a["held"] == "", a["done"]).otherwise(F.array_append(a["done"], a["held"]))
    chunks = F.aggregate(parts, F.struct(none.alias("done"), F.lit("").alias("held")), step, last)
    return docs.select(*(c for c in docs.columns if c != "text"), F.posexplode(chunks).alias("ordinal", "text"))
