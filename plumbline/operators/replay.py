"""Replay manifests: statements of scripts and mappers that can be replayed, changed ones, removed ones, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from plumbline.functions.lexer import count_placeholders, is_ctas, max_in_params
from plumbline.operators.parse import shuffled

_TYPES = {"SELECT": "select", "INSERT": "insert", "UPDATE": "update", "DELETE": "delete", "MERGE": "merge"} | dict.fromkeys(("CREATE_TABLE", "CREATE_INDEX", "CREATE_VIEW", "ALTER_TABLE", "TRUNCATE", "GRANT", "REVOKE"), "ddl") | {"PARSE_ERROR": "other"}
_SESSION = ("START_TRANSACTION", "COMMIT", "ROLLBACK", "SET_VARIABLE", "USE")


def replay_type(kind: Column) -> Column:
    """Null for statements that are not replayed (transactions, session settings)."""
    out = F.when(F.startswith(kind, F.lit("DROP_")), F.lit("ddl")).otherwise(F.lit("other"))
    for k, v in _TYPES.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return F.when(~kind.isin(*_SESSION), out)


def script_statements(asts: DataFrame, types: tuple[str, ...] = ()) -> DataFrame:
    """One row a replayable statement of a script; ids number those that are left after the type filter."""
    s = asts.select("file_path", "text", F.posexplode("ast.statements").alias("i", "s")).select("file_path", "text", "i", F.col("s.kind").alias("kind"), F.col("s.line").alias("line"), F.col("s.end_line").alias("own_end"))
    own = Window.partitionBy("file_path").orderBy("i")
    nxt = F.lead("line").over(own)
    total = F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n"))
    end = F.when(nxt.isNull(), F.greatest(total, F.col("own_end"))).when(nxt > F.col("line"), nxt - 1).otherwise(F.col("own_end"))
    rows = s.select("file_path", "i", "line", "kind", end.cast("long").alias("end_line"), replay_type(F.col("kind")).alias("type"), "text").where("type is not null")
    if types:
        rows = rows.where(F.col("type").isin(*types))
    lines = F.slice(F.split("text", "\n"), F.col("line").cast("int"), (F.col("end_line") - F.col("line") + 1).cast("int"))
    sql = F.regexp_replace(F.trim(F.array_join(lines, "\n")), r"[\s;]+$", "")
    return rows.select(
        F.concat_ws("#", "file_path", F.row_number().over(own).cast("string")).alias("id"), sql.alias("sql"), "type", F.col("file_path").alias("source"), F.lit("sql").alias("source_type"), "line", "end_line",
        F.lit(None).cast("string").alias("statement_id"), F.when(F.col("kind") == "PARSE_ERROR", "parse error").alias("parse_error"), F.lit(None).cast("string").alias("variant_of"), F.lit(None).cast("string").alias("variant_label"),
    )


def mapper_statements(mapper: DataFrame, types: tuple[str, ...] = (), trust_dynamic: bool = False) -> DataFrame:
    """One row a variant of a mapper statement; ids of dynamic ones end in #v1, #v2, ..."""
    from plumbline.operators.parse import parse_scripts

    rows = mapper.where(F.col("statement_type").isin(*types)) if types else mapper
    dynamic = (F.size("variants") > 1) | F.exists("variants", lambda v: v["label"] != "")
    base = F.concat_ws("#", "file_path", "statement_id")
    v = rows.select("file_path", "statement_id", "statement_type", "raw_xml_line", "has_dollar", base.alias("base"), dynamic.alias("dyn"), F.posexplode("variants").alias("k", "v"))
    v = v.select("*", F.trim("v.sql").alias("text")).drop("v.sql")
    parsed = parse_scripts(v.select(*[c for c in v.columns]))
    bad = F.col("ast.parse_error").isNotNull() | F.exists("ast.statements", lambda s: s["kind"] == "PARSE_ERROR")
    dollar = F.lit("contains ${} runtime substitution; statically unchecked (trust_dynamic_substitution enabled)")
    error = F.when(bad & F.col("has_dollar") & F.lit(trust_dynamic), dollar).when(bad, F.coalesce("ast.parse_error", F.lit("parse error in mapper variant")))
    return parsed.select(
        F.when(F.col("dyn"), F.concat("base", F.lit("#v"), (F.col("k") + 1).cast("string"))).otherwise(F.col("base")).alias("id"), F.col("text").alias("sql"), F.col("statement_type").alias("type"), F.col("file_path").alias("source"),
        F.lit("mapper").alias("source_type"), F.col("raw_xml_line").alias("line"), F.col("raw_xml_line").alias("end_line"), "statement_id", error.alias("parse_error"), F.when(F.col("dyn"), F.col("base")).alias("variant_of"), F.when(F.col("dyn"), F.col("v.label")).alias("variant_label"),
    )


def manifest(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def changed(statements: DataFrame, hunks: DataFrame) -> DataFrame:
    """Statements that a hunk touches, with `change`: added in new files, else modified."""
    h = hunks.where("side = 'new'").select(F.col("path").alias("source"), "start_line", F.col("end_line").alias("stop_line"), "is_new")
    on = (statements["source"] == h["source"]) & (statements["line"] <= h["stop_line"]) & (statements["end_line"] >= h["start_line"])
    new_files = h.groupBy("source").agg(F.max("is_new").alias("is_new"))
    hit = shuffled(statements.join(h, on, "left_semi")).join(new_files, "source")
    return hit.select(*statements.columns, F.when(F.col("is_new"), "added").otherwise("modified").alias("change"))


def removed(old: DataFrame, new: DataFrame, hunks: DataFrame) -> DataFrame:
    """Old statements in removed ranges whose id is gone: not there, and not the base of a variant either (equi anti-joins)."""
    h = hunks.where("side = 'old'").select(F.col("path").alias("source"), "start_line", F.col("end_line").alias("stop_line"))
    on = (old["source"] == h["source"]) & (old["line"] <= h["stop_line"]) & (old["end_line"] >= h["start_line"])
    base = lambda c: F.regexp_replace(c, r"#v\d+$", "")
    gone = old.join(h, on, "left_semi")
    kept = new.select(base(F.col("id")).alias("_base")).distinct()
    return gone.withColumn("_base", base(F.col("id"))).join(shuffled(kept), "_base", "left_anti").drop("_base").select("id", "sql", "type", "source", "line", "end_line")


_PROBE = StructType().add("placeholders", IntegerType()).add("in_params", IntegerType()).add("ctas", BooleanType())


@F.pandas_udf(_PROBE)
def _probe(sql):
    import pandas as pd

    return pd.DataFrame([(count_placeholders(x or ""), max_in_params(x or ""), is_ctas(x or "")) for x in sql], columns=["placeholders", "in_params", "ctas"])


def probe(statements: DataFrame) -> DataFrame:
    """statements with placeholders, in_params and ctas."""
    return statements.withColumn("_p", _probe("sql")).select(*statements.columns, "_p.*")


FIXTURES = "map<string,array<string>>"


def read_fixtures(spark, path: str) -> DataFrame:
    """A JSON object {statement id: [values]} -> (stmt_id, params)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", FIXTURES)).alias("stmt_id", "params"))


def bind(statements: DataFrame, fixtures: DataFrame, auto_value: str | None = None) -> DataFrame:
    """statements with `bound`, a value for each placeholder in order: the fixture's (it may be null), beyond it `auto_value`,
    and `has_fixture`. fixtures: (stmt_id, params), one row an id."""
    known = fixtures.select(F.col("stmt_id").alias("id"), F.coalesce("params", F.array().cast("array<string>")).alias("params"))
    rows = probe(statements).join(known, "id", "left")
    given = F.when(F.col("placeholders") > 0, F.sequence(F.lit(1), F.col("placeholders"))).otherwise(F.array().cast("array<int>"))
    value = lambda i: F.when(i <= F.size("params"), F.get("params", i - 1)).otherwise(F.lit(auto_value).cast("string"))
    return rows.select(*statements.columns, "placeholders", (F.col("params").isNotNull() | F.lit(auto_value is not None)).alias("has_fixture"), F.transform(given, value).alias("bound"))


def parameter_findings(statements: DataFrame, fixtures: DataFrame, auto_params: bool = False) -> DataFrame:
    """PARAM001: placeholders without a fixture; DYN003: very long IN lists. fixtures: (stmt_id, params)."""
    known = fixtures.select(F.col("stmt_id").alias("id")).distinct().withColumn("has_fixture", F.lit(True))
    rows = probe(statements).join(known, "id", "left")
    f = F.array_compact(F.array(
        F.when((F.col("placeholders") > 0) & F.col("has_fixture").isNull() & F.lit(not auto_params), F.struct(F.lit("PARAM001").alias("code"), F.concat(F.col("placeholders").cast("string"), F.lit(" placeholders without parameters")).alias("message"))),
        F.when(F.col("in_params") > 1000, F.struct(F.lit("DYN003").alias("code"), F.concat(F.lit("IN list with "), F.col("in_params").cast("string"), F.lit(" parameters")).alias("message"))),
    ))
    return rows.select(F.col("id").alias("stmt_id"), F.explode(f).alias("f")).select("stmt_id", "f.*")


def routing(statements: DataFrame, allow_dml: bool = True, allow_ddl: bool = False) -> DataFrame:
    """statements with `action` (explain, execute or skip) and why."""
    rows = probe(statements)
    skip = (
        F.when(F.col("parse_error").isNotNull(), "parse error").when(F.trim("sql") == "", "empty").when((F.col("type") == "ddl") & F.col("ctas"), "CREATE TABLE AS is not replayed")
        .when((F.col("type") == "ddl") & F.lit(not allow_ddl), "DDL is not replayed").when(F.col("type").isin("insert", "update", "delete", "merge") & F.lit(not allow_dml), "DML is not replayed").when(F.col("type") == "other", "unsupported type")
    )
    return rows.select("id", "type", F.when(skip.isNotNull(), "skip").when(F.col("type") == "select", "execute").otherwise("execute in a rolled-back transaction").alias("action"), skip.alias("reason"))


def report_summary(results: DataFrame) -> DataFrame:
    """results (stmt_id, status, level, n_findings) -> counts and the exit code."""
    n = F.count_if
    row = results.agg(
        F.count(F.lit(1)).alias("total"), n(F.col("status") == "ok").alias("executed"), n(F.col("status") == "error").alias("errors"), n(F.col("status") == "skipped").alias("skipped"),
        n(F.col("level") == "warn").alias("slow_warn"), n(F.col("level") == "error").alias("slow_error"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("findings"),
    )
    return row.withColumn("exit_code", F.when((F.col("slow_error") > 0) | (F.col("errors") > 0), 1).otherwise(0))


MANIFEST_VERSION = "1"
MANIFEST = "version string, id string, sql string, type string, source string, source_type string, line long, end_line long, statement_id string, parse_error string, variant_of string, variant_label string"


def write_manifest(statements: DataFrame, path: str) -> None:
    """One JSON object a line, written in parallel."""
    statements.withColumn("version", F.lit(MANIFEST_VERSION)).write.mode("overwrite").json(path)


def read_manifest(spark, path: str) -> DataFrame:
    """Rows of another version are an error."""
    rows = spark.read.schema(MANIFEST).json(path)
    wrong = F.col("version").isNull() | (F.col("version") != MANIFEST_VERSION)
    return rows.withColumn("version", F.when(wrong, F.raise_error(F.lit("unsupported manifest version"))).otherwise(F.col("version"))).where("version is not null").drop("version")


def report_html(results: DataFrame) -> str:
    """results (stmt_id, status, level, n_findings) as a page: the summary, then statements with findings or errors."""
    import html

    s = report_summary(results).first().asDict()
    head = "".join(f"<li>{k}: {v}</li>" for k, v in s.items())
    rows = results.where("status = 'error' or level <> 'none' or n_findings > 0").orderBy("stmt_id").toLocalIterator()
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in (r.stmt_id, r.status, r.level, r.n_findings)) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><body><ul>{head}</ul><table>{body}</table></body></html>"
