"""The one parse boundary: scripts -> asts, in Arrow batches; everything after it is Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from plumbline import schemas
from plumbline.plans.parser import parse


#: Bytes of texts that are parsed at a time; a parse result holds several copies of its text.
CHUNK = 1 << 20


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the texts of each have about `limit` bytes (a longer text stands alone)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def _parse_batches(dialect: str, fallback: tuple[str, ...], ast_type: StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(ast_type)
        for batch in _chunks(batches, CHUNK):
            seen: dict[str, dict] = {}
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                ast = seen.get(text)
                if ast is None:
                    ast = seen[text] = parse(text, dialect, list(fallback))
                rows.append(ast)
            yield pa.record_batch([*(batch.column(i) for i in range(batch.num_columns)), pa.array(rows, kind)], [*batch.schema.names, "ast"])

    return run


#: Bytes of texts for each core below which they are dealt out anew.
SMALL = 32 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores. A scan with fewer splits than cores, or one so small that its row groups may lie in a few of its splits, is
    dealt out; a large one keeps its splits and is not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(2 * cores) if size < cores * SMALL or rows.rdd.getNumPartitions() < cores else rows


def parse_scripts(scripts: DataFrame, dialect: str = "generic", fallback: tuple[str, ...] = (), distinct_text: bool = False) -> DataFrame:
    """scripts with a column `ast`. A map without a shuffle; `distinct_text` parses each different text once instead (a
    shuffle of the texts), which pays only where most of them repeat."""
    ast_type = _parse_datatype_string(schemas.AST)
    run = _parse_batches(dialect, tuple(fallback), ast_type)
    if distinct_text:
        texts = scripts.select("text").distinct()
        parsed = texts.mapInArrow(run, StructType([*texts.schema.fields]).add("ast", ast_type))
        return scripts.join(parsed, "text", "left").select(*scripts.columns, "ast")
    return spread(scripts).mapInArrow(run, StructType([*scripts.schema.fields]).add("ast", ast_type))


def shuffled(rows: DataFrame) -> DataFrame:
    """rows as a side of a join that is sorted and merged, whatever their estimated size: above all what comes from parse results.

    Spark's estimate takes no notice of how wide `mapInArrow` makes a row, and then divides by that width for a few columns of it, so all rows
    of a corpus look like some KB and would be broadcast, by way of the driver.
    """
    return rows.hint("merge")


def statements(asts: DataFrame) -> DataFrame:
    """One row a statement: file_path, script_type, stmt_index and the statement's fields."""
    return asts.select("file_path", "script_type", F.posexplode("ast.statements").alias("stmt_index", "s")).select("file_path", "script_type", "stmt_index", "s.*")


def selects(asts: DataFrame) -> DataFrame:
    return statements(asts).select("file_path", "stmt_index", "line", F.explode("selects").alias("q")).select("file_path", "stmt_index", "line", "q.*")


def comments(asts: DataFrame) -> DataFrame:
    return asts.select("file_path", F.explode("ast.comments").alias("c")).select("file_path", "c.*")


def statement_at(line: int) -> str:
    """Expression: the first statement of `ast` that holds a line, or null."""
    return f"get(filter(ast.statements, s -> s.line <= {int(line)} and s.end_line >= {int(line)}), 0)"


def file_facts(asts: DataFrame) -> DataFrame:
    """One row a file that has statements: its kinds, created and dropped names, and flags; all from the file's own row."""
    kinds = "array_sort(array_distinct(transform(ast.statements, s -> s.kind)))"
    names = lambda field, name: f"transform(filter(ast.statements, s -> s.{field} is not null), s -> s.{field}.{name})"
    return asts.where("size(ast.statements) > 0").selectExpr(
        "file_path", f"{kinds} kinds", f"{names('create_table', 'table_name')} created_tables", f"{names('drop', 'name')} dropped_objects", "aggregate(ast.statements, 0, (n, s) -> n + coalesce(size(s.selects), 0)) select_count",
        "exists(ast.statements, s -> s.kind = 'CREATE_TABLE') has_create_table", "exists(ast.statements, s -> s.kind = 'DROP_TABLE') has_drop_table",
    )


#: Expressions over a select `x`.
SELECT_FACTS = {
    "order_by_text": "x.order_by_text",
    "order_by_without_direction": "exists(x.order_by, o -> o.asc is null)",
    "order_by_without_nulls": "exists(x.order_by, o -> o.nulls_first is null)",
    "has_cross_join": "exists(x.joins, j -> j.join_type = 'CROSS')",
    "join_without_condition": "exists(x.joins, j -> not j.has_condition)",
}


def references(qualifier: str) -> str:
    """Expression: select `x` refers to a table or an alias of that name."""
    return f"array_contains(x.qualifiers, upper({qualifier}))"


def sets_column(column: str) -> str:
    """Expression: statement `s` is an UPDATE that sets the column."""
    return f"coalesce(exists(s.update.set_columns, c -> lower(c) = lower({column})), false)"


def select_accessors(asts: DataFrame) -> DataFrame:
    """One row a select: file_path, stmt_index, select_id and `SELECT_FACTS`."""
    rows = asts.select("file_path", F.posexplode("ast.statements").alias("stmt_index", "s")).select("file_path", "stmt_index", F.explode("s.selects").alias("x"))
    return rows.select("file_path", "stmt_index", "x.select_id", *[F.expr(e).alias(n) for n, e in SELECT_FACTS.items()])


def explain(asts: DataFrame) -> DataFrame:
    """The parse result of every file as JSON text."""
    return asts.select("file_path", F.to_json("ast").alias("ast_json"))
