"""Reports over violations, and the result cache."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain_lines(found: DataFrame) -> DataFrame:
    """One line a violation, by severity (falling as text: warnings first), then path and line."""
    at = F.concat_ws(":", "file_path", F.col("line").cast("string"), F.col("column").cast("string"))
    line = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), at, F.lit(" "), F.col("rule_id"), F.lit(" ("), F.col("rule_name"), F.lit("): "), F.col("message"))
    return found.orderBy(F.desc("severity"), "file_path", "line", "column", "rule_id").select(line.alias("line"))


def summary(found: DataFrame, files_checked: int = 0, missing: int = 0, unexpected: int = 0) -> DataFrame:
    n = F.count_if
    row = found.agg(F.count(F.lit(1)).alias("total"), n(F.col("severity") == "error").alias("errors"), n(F.col("severity") == "warning").alias("warnings"))
    return row.select((F.col("total") + missing == 0).alias("passed"), F.lit(files_checked).alias("files_checked"), "total", "errors", "warnings", F.lit(missing).alias("missing_directories"), F.lit(unexpected).alias("unexpected_directories"))


def by_rule(found: DataFrame) -> DataFrame:
    """Counts for groups and rules, with totals (rollup)."""
    return found.rollup("rule_group", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "error").alias("errors"))


def json_rows(found: DataFrame) -> DataFrame:
    row = F.struct("rule_id", F.col("rule_name").alias("rule"), F.col("rule_group").alias("group"), "severity", "message", F.col("file_path").alias("file"), "script_type", "line", "end_line", "column")
    return found.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def write_json(found: DataFrame, path: str) -> None:
    """Violations as JSON lines, written in parallel."""
    json_rows(found).write.mode("overwrite").text(path)


_LEVEL = {"error": "error", "warning": "warning"}
_ORDER = ["file_path", "line", "column", "rule_id"]


def sarif_parts(found: DataFrame, tool: str = "plumbline", missing: tuple[str, ...] = ()) -> Iterator[str]:
    """A SARIF 2.1.0 document, piece by piece; rules in the order of their first violation. Results are fetched a partition at a time."""
    firsts = found.groupBy("rule_id").agg(F.min_by(F.struct("rule_name", "rule_group"), F.struct(*_ORDER)).alias("r"), F.min(F.struct(*_ORDER)).alias("at")).orderBy("at").collect()  # a row for each rule
    index = {r.rule_id: i for i, r in enumerate(firsts)}
    rules = [{"id": r.rule_id, "name": r.r.rule_name, "properties": {"group": r.r.rule_group}} for r in firsts]
    if missing:
        index["STRUCT001"] = len(rules)
        rules.append({"id": "STRUCT001", "name": "directory_structure", "properties": {"group": "structure"}})
    put = lambda x: json.dumps(x, ensure_ascii=False)
    yield '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": ' + put({"name": tool, "rules": rules}) + '}, "results": ['
    between = ""
    for r in found.orderBy(*_ORDER).toLocalIterator():
        region = {k: v for k, v in (("startLine", r.line), ("endLine", r.end_line), ("startColumn", r.column)) if v is not None}
        place = {"artifactLocation": {"uri": r.file_path}} | ({"region": region} if "startLine" in region else {})
        yield between + put({"ruleId": r.rule_id, "ruleIndex": index[r.rule_id], "level": _LEVEL.get(r.severity, "note"), "message": {"text": r.message}, "locations": [{"physicalLocation": place}]})
        between = ",\n"
    for path in missing:
        yield between + put({"ruleId": "STRUCT001", "ruleIndex": index["STRUCT001"], "level": "error", "message": {"text": f"Required directory is missing: {path}"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": path}}}]})
        between = ",\n"
    yield "]}]}\n"


def sarif(found: DataFrame, tool: str = "plumbline", missing: tuple[str, ...] = ()) -> str:
    """The document as one text, for results that fit a report."""
    return "".join(sarif_parts(found, tool, missing))


def html_parts(found: DataFrame, title: str = "SQL check") -> Iterator[str]:
    """A page with a table of all violations, piece by piece."""
    yield f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr><th>severity</th><th>rule</th><th>file</th><th>line</th><th>message</th></tr>"
    for r in found.orderBy(F.desc("severity"), "file_path", "line", "rule_id").toLocalIterator():
        cells = "".join(f"<td>{html.escape(str(x if x is not None else ''))}</td>" for x in (r.severity, r.rule_id, r.file_path, r.line, r.message))
        yield f"<tr class='{html.escape(r.severity)}'>{cells}</tr>"
    yield "</table></body></html>"


def html_report(found: DataFrame, title: str = "SQL check") -> str:
    return "".join(html_parts(found, title))


def write_plain(found: DataFrame, path: str) -> None:
    """Lines of the plain report in order, written in parallel: a folder of parts."""
    plain_lines(found).write.mode("overwrite").text(path)


#: Formats that are a folder of parts, and those that are one document.
PARALLEL, DOCUMENTS = {"plain": write_plain, "json": write_json}, {"sarif": sarif_parts, "html": html_parts}


def write_reports(found: DataFrame, folder: str, formats: tuple[str, ...] = ("plain",)) -> list[str]:
    """Reports below `folder`: plain and json by Spark's writers, sarif and html as documents (on the driver's file system)."""
    out = []
    for f in formats:
        path = f"{folder.rstrip('/')}/report.{ {'plain': 'txt'}.get(f, f) }"
        if f in PARALLEL:
            PARALLEL[f](found, path)
        else:
            with open(path, "w", encoding="utf-8") as to:
                to.writelines(DOCUMENTS[f](found))
        out.append(path)
    return out


# --- cache: results of files that did not change --------------------------------------------------------------------------------
def run_signature(*parts: str):
    return F.sha2(F.concat_ws("\x1f", *[F.lit(p) for p in parts]), 256)


def cache_split(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to check, results that still hold): a hit has the same path, time in seconds and size."""
    key = files.select("file_path", F.unix_timestamp("mtime").alias("mtime_sec"), "size")
    keyed = files.withColumn("mtime_sec", F.unix_timestamp("mtime"))
    seen = cached.select("file_path", "mtime_sec", "size").distinct()
    misses = keyed.join(seen, ["file_path", "mtime_sec", "size"], "left_anti").drop("mtime_sec")
    return misses, cached.join(key, ["file_path", "mtime_sec", "size"], "left_semi")


def cache_rows(files: DataFrame, found: DataFrame) -> DataFrame:
    """A row a violation, and one with null rule for a clean file, keyed by path, time and size."""
    key = files.select("file_path", F.unix_timestamp("mtime").alias("mtime_sec"), "size")
    return key.join(found, "file_path", "left")


def cache_write(rows: DataFrame, path: str, signature: str) -> None:
    """Put the rows of checked files in place of what the cache holds of them under this signature; other files' rows stay.

    A generation is a folder `run_signature=.../gen=N`; the newest is read, and older ones go when it is complete.
    """
    spark = rows.sparkSession
    held, last = _newest(spark, path, signature)
    new = rows if held is None else held.join(rows.select("file_path").distinct(), "file_path", "left_anti").unionByName(rows)
    new.write.mode("overwrite").parquet(f"{_generation(path, signature, last + 1)}")
    for k in range(last + 1):
        _delete(spark, _generation(path, signature, k))


def cache_read(spark, path: str, signature: str) -> DataFrame | None:
    """The newest complete rows of a signature, or None."""
    return _newest(spark, path, signature)[0]


def _generation(path: str, signature: str, k: int) -> str:
    return f"{path.rstrip('/')}/run_signature={signature}/gen={k}"


def _files(spark, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _delete(spark, path: str) -> None:
    fs, where = _files(spark, path)
    fs.delete(where, True)


def _newest(spark, path: str, signature: str) -> tuple[DataFrame | None, int]:
    fs, where = _files(spark, f"{path.rstrip('/')}/run_signature={signature}")
    if not fs.exists(where):
        return None, -1
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    done = sorted(int(n[4:]) for n in names if n.startswith("gen=") and fs.exists(_files(spark, f"{path.rstrip('/')}/run_signature={signature}/{n}/_SUCCESS")[1]))
    return (spark.read.parquet(_generation(path, signature, done[-1])), done[-1]) if done else (None, -1)
