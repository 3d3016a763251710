"""A reproducible shuffle into shards: a Feistel permutation of global row numbers (Spark expressions only).

Rows get dense global numbers in an order that depends only on their content. A generalised Feistel network over a x b, the
smallest rectangle near a square that holds all numbers, permutes them; a number that falls outside walks its cycle until it
comes back in. There are a * b - n such places, so a walk needs at most that many extra steps, and a and b are chosen to
make them few. Shard and slot follow from the permuted number by division, so shard sizes differ by one at most, slots
have no gaps, and the place of any row can be computed from its number alone.

Defined cases: a null text has 0 bytes and CRC 0; rows with equal id, size and text are interchangeable; null ids sort first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import in_blocks, materialize

SHARDS = 40
#: Bytes that every document has beside its text.
OVERHEAD = 16
KEYS = (0x1F83D9AB, 0x5BE0CD19, 0x2B7E1516, 0x28AED2A6)
#: Rows that a task numbers, about.
BUCKET_ROWS = 1 << 16


def rectangle(n: int) -> tuple[int, int]:
    """a, b with a * b >= n, near a square, with as few places over as can be found."""
    top = max(1, math.isqrt(max(n - 1, 0)) + 1)
    sides = range(top, max(top // 2, top - 4096, 1) - 1, -1)
    return min(((a, -(-n // a)) for a in sides), key=lambda s: s[0] * s[1] - n) if n else (1, 1)


def permute(x: Column, n: int, keys: tuple[int, ...] = KEYS) -> Column:
    """Image of x in 0 .. n - 1 under the permutation of the given keys."""
    a, b = rectangle(n)

    def once(y: Column) -> Column:
        start = F.struct((y % a).alias("u"), F.floor(y / a).cast("long").alias("v"))

        def step(s: Column, k: Column) -> Column:
            u = (s["u"] + F.pmod(F.xxhash64(s["v"], k), F.lit(a).cast("long"))) % a
            return F.struct(u.alias("u"), ((s["v"] + F.pmod(F.xxhash64(k, u), F.lit(b).cast("long"))) % b).alias("v"))

        return F.aggregate(F.array(*[F.lit(k).cast("long") for k in keys]), start, step, lambda s: s["u"] + s["v"] * a)

    return F.aggregate(F.array_repeat(F.lit(1), a * b - n), once(x.cast("long")), lambda y, _: F.when(y >= n, once(y)).otherwise(y))


def global_rows(keyed: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """keyed with a dense `row` number from 0, and the number of rows.

    Equal rows are counted first, so a row that is repeated any number of times is one entry for each `COPIES_AT_ONCE` copies
    until the end, and those entries are in different buckets.
    """
    counted = materialize(keyed.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")))
    n = counted.agg(F.sum("copies")).first()[0] or 0
    buckets = n // BUCKET_ROWS + 1
    placed = in_blocks(counted).withColumn("bucket", F.pmod(F.xxhash64(*columns, "block"), F.lit(buckets)))
    sizes = placed.groupBy("bucket").agg(F.sum("copies").alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    offsets = sizes.select("bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("bucket").orderBy(*columns, "block").rowsBetween(Window.unboundedPreceding, -1)
    started = placed.withColumn("start", F.coalesce(F.sum("copies").over(own), F.lit(0))).join(offsets, "bucket")
    numbered = started.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return numbered.select(*columns, (F.col("base") + F.col("start") + F.col("nth")).alias("row")), n


def keyed_documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row."""
    numbered, n = global_rows(keyed_documents(docs), ["doc_id", "size", "text_crc32"])
    placed = numbered.withColumn("place", permute(F.col("row"), n))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write the documents to `path`, one folder for each shard, in slot order; returns the assignment.

    All columns of docs are written as they are; `shard` and `slot` are added, so a column of docs with such a name is an error.
    Null and repeated ids: rows equal in id, size and CRC take their slots in any order.
    """
    if {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError("columns shard and slot are added by write_shards")
    assigned = materialize(assign(docs, shards))
    key = ["doc_id", "size", "text_crc32"]
    text = F.coalesce("text", F.lit(""))
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")).alias("_key")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))
    rows = docs.select(F.struct("*").alias("_row"), own).withColumn("_nth", nth)
    slots = assigned.select(F.struct(*key).alias("_key"), "row", "shard", "slot").withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("row")))
    joined = rows.join(slots, [rows["_key"].eqNullSafe(slots["_key"]), rows["_nth"] == slots["_nth"]]).select("_row.*", "shard", "slot")
    joined.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return assigned
