"""Findings over query plans and timings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from plumbline import schemas

SCAN_ROWS, OUTER_ROWS, STREAM_ROWS, RATIO, IN_PARAMS = 10_000, 1_000, 100_000, 10.0, 1_000
WARN_MS, ERROR_MS = 100.0, 1000.0


def _walk(stmt_id: str, plan: str) -> Iterator[dict]:
    try:
        root = json.loads(plan or "")
    except ValueError:
        return
    root = root[0] if isinstance(root, list) and root else root
    if not isinstance(root, dict) or "Plan" not in root:
        return
    stack, n = [(root["Plan"], -1, 0)], 0
    while stack:
        p, parent, child = stack.pop()
        me, n = n, n + 1
        text = lambda k, p=p: None if p.get(k) is None else str(p[k])
        yield {
            "stmt_id": stmt_id, "node_id": me, "parent_id": parent, "child_idx": child, "node_type": text("Node Type"), "relation": text("Relation Name"), "index_name": text("Index Name"),
            "startup_cost": float(p.get("Startup Cost", 0)), "total_cost": float(p.get("Total Cost", 0)), "plan_rows": int(p.get("Plan Rows", 0)), "actual_rows": int(p.get("Actual Rows", 0)),
            "actual_loops": int(p.get("Actual Loops", 0)), "has_actual": "Actual Rows" in p, "filter": text("Filter"), "index_cond": text("Index Cond"), "sort_key": text("Sort Key"),
        }
        stack += [(c, me, i) for i, c in enumerate(p.get("Plans", []))]


def plan_nodes(plans: DataFrame) -> DataFrame:
    """plans (stmt_id, plan_json: a tree) -> one row a node."""
    kind = _parse_datatype_string(schemas.PLAN_NODES)

    def run(batches):
        arrow = to_arrow_schema(kind)
        for b in batches:
            rows = [r for s, p in zip(b.column("stmt_id").to_pylist(), b.column("plan_json").to_pylist(), strict=True) for r in _walk(s, p)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return plans.select("stmt_id", "plan_json").mapInArrow(run, kind)


def mysql_plan_nodes(plans: DataFrame) -> DataFrame:
    """plans (stmt_id, plan_json: a flat array of type, table, key, rows, Extra) -> nodes, without Python."""
    row = "array<struct<type:string,table:string,key:string,rows:bigint,Extra:string>>"
    n = plans.select("stmt_id", F.posexplode(F.from_json("plan_json", row)).alias("node_id", "p"))
    return n.select("stmt_id", "node_id", F.col("p.type").alias("node_type"), F.col("p.table").alias("relation"), F.col("p.key").alias("index_name"), F.coalesce("p.rows", F.lit(0)).alias("plan_rows"), F.col("p.Extra").alias("filter"))


def _explode(nodes: DataFrame, cases: list) -> DataFrame:
    row = lambda code, cond, m: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit("warning").alias("severity"), m.alias("message")))
    found = F.array_compact(F.array(*[row(*c) for c in cases]))
    return nodes.select("stmt_id", "node_id", "node_type", "relation", F.explode(found).alias("f")).select("stmt_id", "f.code", "f.severity", "f.message", "node_type", "relation", "node_id")


def findings(nodes: DataFrame, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """DP001-DP004, DP007, DP008. The nested-loop rule needs the first child: one equi-join on (statement, parent)."""
    first = nodes.where("child_idx = 0 and parent_id >= 0").select("stmt_id", F.col("parent_id").alias("node_id"), F.col("plan_rows").alias("outer_rows"))
    loops = nodes.where("node_type = 'Nested Loop'").join(first, ["stmt_id", "node_id"])
    rows, kind = F.col("plan_rows"), F.col("node_type")
    say = lambda before, n, after=")": F.concat(F.lit(before), n.cast("string"), F.lit(after))
    single = _explode(nodes, [
        ("DP001", F.contains(kind, F.lit("Seq Scan")) & (rows > scan_rows), say("full scan of a large table (Seq Scan, estimated rows ", rows)),
        ("DP003", (kind == "Sort") & (rows > scan_rows), say("large sort (Sort, estimated rows ", rows)),
        ("DP004", F.col("has_actual") & (rows > 0) & (F.abs(F.col("actual_rows") - rows) / F.when(rows > 0, rows) > RATIO), F.concat(F.lit("estimate far from actual rows (estimated "), rows.cast("string"), F.lit(", actual "), F.col("actual_rows").cast("string"), F.lit("); statistics may be stale"))),
        ("DP007", (kind == "Bitmap Heap Scan") & (rows > scan_rows), say("many rows by Bitmap Heap Scan (estimated rows ", rows)),
        ("DP008", F.contains(kind, F.lit("Streaming")) & (rows > STREAM_ROWS), say("many rows redistributed by Streaming (", rows)),
    ])
    outer = F.col("outer_rows")
    return single.unionByName(_explode(loops, [("DP002", outer > OUTER_ROWS, say("large outer side of a nested loop (", outer))]))


def mysql_findings(nodes: DataFrame, scan_rows: int = SCAN_ROWS) -> DataFrame:
    kind, extra, rows = F.lower(F.coalesce("node_type", F.lit(""))), F.lower(F.coalesce("filter", F.lit(""))), F.col("plan_rows")
    say = lambda before: F.concat(F.lit(before), rows.cast("string"), F.lit(")"))
    return _explode(nodes, [
        ("DP001", (kind == "all") & (rows > scan_rows), say("full scan of a large table (type=ALL, estimated rows ")),
        ("DP003", F.contains(extra, F.lit("using filesort")) & (rows > scan_rows), say("large sort (Using filesort, estimated rows ")),
        ("DP006", F.contains(extra, F.lit("using temporary")), F.lit("temporary table (Using temporary)")),
        ("DP009", (kind == "all") & (F.coalesce("index_name", F.lit("")) == "") & (rows > 0), F.lit("access without an index (type=ALL, key=null)")),
    ])


def timing_stats(timings: DataFrame, keys: list[str], warn_ms: float = WARN_MS, error_ms: float = ERROR_MS) -> DataFrame:
    """timings (keys, ms) -> n, min, p50 (mean of the middle two), p99 (maximum below 100 samples, else the rank), avg, level."""
    n = F.count(F.lit(1))
    p99 = F.when(n < 100, F.max("ms")).otherwise(F.expr("percentile_disc(0.99) within group (order by ms)"))
    out = timings.groupBy(*keys).agg(n.alias("n"), F.min("ms").alias("min_ms"), F.percentile("ms", F.lit(0.5)).alias("p50_ms"), p99.alias("p99_ms"), F.avg("ms").alias("avg_ms"))
    return out.withColumn("level", F.when(F.col("p50_ms") >= error_ms, "error").when(F.col("p50_ms") >= warn_ms, "warn").otherwise("none"))
