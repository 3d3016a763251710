"""Checking a folder as files arrive; the checkpoint takes the place of the result cache."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.engine import check
from plumbline.operators.rules import Rule
from plumbline.sources.files import SQL_FILE, classify

_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, rules: list[tuple[str, str, int]], default: str = "sql", max_files: int = 1000) -> DataFrame:
    """A stream of scripts (file_path, script_type, text) from files below `root`."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    kept = files.where(F.col("path").rlike(SQL_FILE))
    return kept.select(F.col("path").alias("file_path"), classify(F.col("path"), rules, default).alias("script_type"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def start(scripts: DataFrame, sink: str, checkpoint: str, rules: Iterable[Rule] | None = None, on_batch: Callable[[DataFrame], None] | None = None, once: bool = True) -> StreamingQuery:
    """Append violations of each batch to a Parquet table; rules are a map, so the stream keeps no state."""

    def each(batch: DataFrame, _: int) -> None:
        found = check(batch, rules)
        found.write.mode("append").parquet(sink)
        if on_batch:
            on_batch(found)

    writer = scripts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
