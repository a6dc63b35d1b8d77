"""Tables of batches: a Parquet folder for each batch, written whole or not at all.

A batch is named by a number, and writing it again replaces it, so a run that was cut short
and is repeated leaves each row once.  Readers see a batch once Spark's success mark is there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class BatchTable:
    spark: SparkSession
    folder: str
    schema: str

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the complete batches, in order."""
        _, files = self._files()
        marks = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch-*/_SUCCESS"))
        return sorted(int(m.getPath().getParent().getName().removeprefix("batch-")) for m in marks or [])

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch-{batch:09d}")

    def read(self, *, before: int | None = None) -> DataFrame:
        """Rows of all complete batches, or of those with a number below ``before``."""
        paths = [f"{self.folder}/batch-{b:09d}" for b in self.batches() if before is None or b < before]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
