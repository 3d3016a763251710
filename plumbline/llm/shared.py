"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of a row that one task writes out.
COPIES_AT_ONCE = 1 << 16


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: that of ``spark.checkpoint.dir``, or the one set on the context. Where neither is set, a temporary folder in
    local mode (tests); on a cluster that is an error, since executors do not share such a folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, so that a lost executor loses no result."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (.., copies) with `block`: a row of very many copies becomes several, each of at most `COPIES_AT_ONCE`, to be dealt apart."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES_AT_ONCE)))
    left = F.col("copies") - F.col("block") * COPIES_AT_ONCE
    return rows.withColumn("block", blocks).withColumn("copies", F.least(left, F.lit(COPIES_AT_ONCE).cast("long")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_rows(docs: DataFrame, mask, limit: int | None = None) -> DataFrame:
    """Rows of docs for which `mask(record batch)` is true, with all columns: one pass, no shuffle. `limit`: bytes of text at a time."""
    import pyarrow as pa

    from plumbline.llm.textvec import CHUNK_BYTES, chunks

    def run(batches):
        judge = mask()
        for batch in chunks(batches, "text", limit or CHUNK_BYTES):
            yield batch.filter(pa.array(judge(batch)))

    return docs.mapInArrow(run, docs.schema)
