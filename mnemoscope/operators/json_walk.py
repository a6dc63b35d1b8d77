"""Walks through nested JSON as joins, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import ensure_checkpoint_dir


def references(rows: DataFrame, *, pattern: str = r"obs:(\d+)") -> DataFrame:
    """(id, ref): numbers in strings of the JSON of ``rows`` (id, detail) that are a reference as a whole, at any depth, each once.

    Values are taken apart level by level, all rows at once, so a large detail is many rows and no task walks it alone.  Keys, and
    references within longer strings, don't count; what is no JSON, and null, has none. A level is written before the next.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    kind = F.schema_of_variant("v")
    level, found = rows.select("id", F.try_parse_json("detail").alias("v")).where("v is not null"), None
    while True:
        text = F.trim(F.try_variant_get("v", "$", "string"))
        own = level.where(kind == "STRING").select("id", F.regexp_extract(text, f"^(?:{pattern})$", 1).alias("ref")).where("ref <> ''").select("id", F.col("ref").cast("long").alias("ref"))
        found = own if found is None else found.unionByName(own)
        inner = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        children = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("id", F.col("value").alias("v"))
        level = children.where(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "STRING")).checkpoint()
        if level.isEmpty():
            return found.distinct()
