"""Join relations between tables, mined from the root selects of parsed statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(asts: DataFrame) -> DataFrame:
    """One row a joined column pair: file_path, stmt_index, line, edge_index and both ends with the join type."""
    s = asts.select("file_path", F.posexplode("ast.statements").alias("stmt_index", "s")).where("s.kind = 'SELECT'")
    e = s.select("file_path", "stmt_index", F.col("s.line").alias("line"), F.col("s.end_line").alias("end_line"), F.posexplode(F.get("s.selects", F.lit(0))["edges"]).alias("edge_index", "e"))
    return e.select("file_path", "stmt_index", "line", "end_line", "edge_index", "e.*")


def _end(table: str, column: str) -> Column:
    return F.concat_ws(".", F.lower(table), F.lower(column))


def relations(found: DataFrame) -> DataFrame:
    """Undirected relations: ends, direction hint, join types and occurrences.

    The first edge (by file, statement, edge) of a pair fixes its ends; when just one column ends in `_id` that side points to
    the other. Aggregation is partial, so a pair that is everywhere is no hot spot.
    """
    a, b = _end("left_table", "left_column"), _end("right_table", "right_column")
    rows = found.select("*", F.least(a, b).alias("k1"), F.greatest(a, b).alias("k2"))
    order = F.struct("file_path", "stmt_index", "edge_index")
    ends = F.struct("left_table", "left_column", "right_table", "right_column")
    grouped = rows.groupBy("k1", "k2").agg(
        F.min(F.struct(order.alias("o"), ends.alias("e")))["e"].alias("e"), F.array_sort(F.collect_set("join_type")).alias("join_types"), F.count(F.lit(1)).alias("occurrences"), F.approx_count_distinct("file_path").alias("files_about"),
    )
    left_id, right_id = F.lower("e.left_column").like("%\\_id"), F.lower("e.right_column").like("%\\_id")
    hint = F.when(left_id & ~right_id, "left->right").when(right_id & ~left_id, "right->left").otherwise("undirected")
    swap = hint == "right->left"
    side = lambda x, y: F.when(swap, F.col(f"e.{y}")).otherwise(F.col(f"e.{x}"))
    return grouped.select(
        side("left_table", "right_table").alias("from_table"), side("left_column", "right_column").alias("from_column"), side("right_table", "left_table").alias("to_table"), side("right_column", "left_column").alias("to_column"),
        F.when(hint == "undirected", "undirected").otherwise("directed").alias("direction"), F.array_join("join_types", ",").alias("join_types"), "occurrences",
    )


def evidence(found: DataFrame) -> DataFrame:
    """Where each relation was seen; one row an occurrence, so that no list grows without bound."""
    a, b = _end("left_table", "left_column"), _end("right_table", "right_column")
    return found.select(F.least(a, b).alias("end_a"), F.greatest(a, b).alias("end_b"), "join_type", "file_path", "line")


def stats(rel: DataFrame) -> DataFrame:
    return rel.agg(F.count(F.lit(1)).alias("relation_count"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrence_total"))
