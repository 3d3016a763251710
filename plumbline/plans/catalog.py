"""Driver queries: every operator on a table-derived input. `plumbline.plans.oracles` states the same results in SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import idents
from plumbline.functions.lexer import normalize_placeholders, repair_artifacts, rewrite_oracle_style, tokenize, top_words
from plumbline.functions.text import line_range, text_slice
from plumbline.operators import engine, plan_findings, relations, replay, reports, rollback
from plumbline.operators.explain import explain_text
from plumbline.operators.incremental import check_diff as diff_check
from plumbline.operators.parse import comments, explain, file_facts, parse_scripts, references, selects, shuffled, statement_at, statements
from plumbline.operators.parse import select_accessors as accessors
from plumbline.operators.rules import ALL, BY_ID, CORE, user_rule, when
from plumbline.operators.rules import text as quote
from plumbline.plans import corpus
from plumbline.plans.corpus import table, templated
from plumbline.sources import diff, files, mapper

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _asts(spark: SparkSession, sf: str, templates: list) -> DataFrame:
    return parse_scripts(templated(spark, sf, templates))


def _all_rules(only: engine.RuleFilter = engine.RuleFilter()):
    return engine.select_rules(ALL, only, all_enabled=True)


_HIT = ["file_path", "rule_id", "severity", "line", "end_line"]


@query
def violations(spark, sf):
    """E1, E3, P1-P16 and most rules: all rules over the main corpus."""
    return engine.violations(_asts(spark, sf, corpus.MAIN), _all_rules()).select(*_HIT)


@query
def violations_default(spark, sf):
    """Only rules that are on by default, with message and place."""
    found = engine.violations(_asts(spark, sf, corpus.MAIN), engine.select_rules())
    return found.select("file_path", "script_type", "rule_id", "rule_name", "rule_group", "message", "line", F.col("column").alias("col"))


@query
def violations_lines(spark, sf):
    """E4, E5 exemptions; DDL002, DDL004, DML007, DML103, DML104, GDDL001; PARSE on text that does not tokenize."""
    only = engine.RuleFilter(include=("DDL001", "DDL002", "DDL004", "DML001", "DML002", "DML007", "DML103", "DML104", "gaussdb:GDDL001"))
    return engine.violations(_asts(spark, sf, corpus.LINES), _all_rules(only)).select(*_HIT)


@query
def violations_names(spark, sf):
    """DDL003, DDL005-DDL007 and the naming, type, object and index rules of the second pack."""
    only = engine.RuleFilter(exclude=("DDL002", "DDL004", "GPERF001"))
    return engine.violations(_asts(spark, sf, corpus.NAMES), _all_rules(only)).select("file_path", "rule_id", "message", "line")


@query
def violations_repeated(spark, sf):
    """The main corpus with repeated texts, each different text parsed once."""
    asts = parse_scripts(templated(spark, sf, corpus.MAIN, distinct=False), distinct_text=True)
    return engine.violations(asts, _all_rules()).select(*_HIT)


def _composed(spark, sf, parts, script_type="dml"):
    return engine.violations(parse_scripts(corpus.composed(spark, sf, parts, script_type)), _all_rules())


@query
def rules_on_reads(spark, sf):
    """Rules on SELECT over texts put together from parts."""
    return _composed(spark, sf, corpus.READS).select("file_path", "rule_id", "line")


@query
def rules_on_changes(spark, sf):
    """Rules on UPDATE and DELETE over texts put together from parts."""
    found = _composed(spark, sf, corpus.CHANGES)
    return found.select("file_path", "rule_id", "line")


@query
def rules_on_shapes(spark, sf):
    """Numbers of tables, unused names, nested CASE, joins without condition."""
    return _composed(spark, sf, corpus.SHAPES).select("file_path", "rule_id", "line")


@query
def rules_on_lengths(spark, sf):
    """GPERF001: statements around the limit."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("SELECT a FROM t WHERE b = '"), F.repeat(F.lit("x"), (k % 200 + 4990).cast("int")), F.lit("'"))
    rows = table(spark, sf, "orders").select(F.concat(F.lit("o/"), k, F.lit(".sql")).alias("file_path"), F.lit("dml").alias("script_type"), text.alias("text"))
    return engine.violations(parse_scripts(rows), _all_rules()).select("file_path", "rule_id", "message")


@query
def rules_on_tables(spark, sf):
    """GNAM001, GNAM002, GNAM004, GTYP001, DDL007: names and columns by formula."""
    return _composed(spark, sf, corpus.TABLES, "ddl").select("file_path", "rule_id", "message")


@query
def user_rules(spark, sf):
    """Rules of a user; a script that is missing and one that does not run."""
    with tempfile.TemporaryDirectory() as folder:
        for name, text in (("limit.sql", when("r.has_limit", "concat('LIMIT of ', r.from_tables[0])")), ("wrong.sql", "no_such_function(s)")):
            Path(folder, name).write_text(text, encoding="utf-8")
        rules = [user_rule(spark, f"LOCAL{i + 1}", path, kinds=("SELECT",) if i == 0 else ()) for i, path in enumerate((f"{folder}/limit.sql", "rules/none.sql", f"{folder}/wrong.sql"))]
    asts = _asts(spark, sf, [("dml", "SELECT a FROM s{k} LIMIT 1"), ("dml", "SELECT a FROM t{k}")])
    found = engine.violations(asts, rules)
    return found.select("file_path", "rule_id", F.regexp_replace("message", "(?s)^(Rule execution error):.*", "$1").alias("message"), "line")


@query
def dialect_fallback(spark, sf):
    """Each statement by the first dialect of the chain that takes it."""
    rows = templated(spark, sf, [("dml", x) for x in corpus.DIALECTS])
    out = None
    for dialect, fallback in (("postgresql", ("oracle",)), ("mysql", ()), ("oracle", ()), ("gaussdb", ())):
        found = parse_scripts(rows, dialect, fallback).selectExpr("file_path", f"'{dialect}' dialect", "ast.statements[0].kind kind", "get(ast.statements[0].selects, 0) r")
        found = found.selectExpr("file_path", "dialect", "kind", "r.is_except", "r.has_unqualified_column unqualified")
        out = found if out is None else out.unionByName(found)
    return out


@query
def check_diff(spark, sf):
    """Changed files by the end of their path, rules by hunk, checks of bytes for the whole file."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    line = F.when(k % 5 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    text = F.concat(F.lit("DELETE FROM a"), s, F.lit(";"), line, F.lit("UPDATE b SET x = "), s, F.lit(";"), line, F.lit("SELECT * FROM c"), s)
    rows = table(spark, sf, "orders").select(F.concat(F.lit("o/"), s, F.lit(".sql")).alias("file_path"), F.lit("dml").alias("script_type"), text.alias("text")).withColumn("content", F.encode("text", "UTF-8"))
    at = (k % 4 + 1).cast("long")
    hunks = table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.concat(F.lit("sql/o/"), s, F.lit(".sql")).alias("path"), F.lit("new").alias("side"), at.alias("start_line"), at.alias("end_line"), (k % 7 == 0).alias("is_new"))
    return diff_check(rows, hunks, [BY_ID["DML001"], BY_ID["DML002"]]).select("file_path", "rule_id", "line")


@query
def explain_tree(spark, sf):
    """The parse result as an indented text."""
    return explain_text(_asts(spark, sf, [
        ("ddl", "CREATE TABLE t{k} (id INT PRIMARY KEY, n VARCHAR(10) NOT NULL DEFAULT 'x')"), ("dml", "SELECT DISTINCT a{k}, b.c AS d FROM t LEFT JOIN b ON t.i = b.i WHERE a > 1 ORDER BY a DESC LIMIT 3"),
        ("dml", "-- note\nDELETE FROM t{k};\nSELEC 1"),
    ]))


@query
def bound_parameters(spark, sf):
    """Values of a statement's placeholders."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    sql = F.concat(F.lit("SELECT '?' FROM t"), F.when(k % 4 > 0, F.concat(F.lit(" WHERE "), F.array_join(F.array_repeat(F.lit("a = ?"), (k % 4).cast("int")), " AND "))).otherwise(""))
    fixtures = c.where("c_custkey % 3 = 0").select(k.cast("string").alias("stmt_id"), F.array(F.concat(F.lit("v"), k), F.lit(None)).alias("params"))
    bound = replay.bind(c.select(k.cast("string").alias("id"), sql.alias("sql")), fixtures)
    return bound.select("id", "placeholders", "has_fixture", F.array_join("bound", ",", "null").alias("bound"))


@query
def select_accessors(spark, sf):
    """What is derived from a select."""
    texts = ["SELECT a FROM t{k} ORDER BY a, b DESC", "SELECT a FROM t{k} ORDER BY a ASC NULLS LAST", "SELECT a.x FROM a CROSS JOIN b{k}", "SELECT a.x FROM a INNER JOIN b{k}"]
    asts = _asts(spark, sf, [("dml", x) for x in texts])
    uses = asts.select("file_path", F.expr(f"element_at(transform(array(ast.statements[0].selects[0]), x -> {references(quote('a'))}), 1)").alias("uses_a"))
    return shuffled(accessors(asts)).join(uses, "file_path").select("file_path", "order_by_text", "order_by_without_direction", "order_by_without_nulls", "has_cross_join", "join_without_condition", "uses_a")


@query
def rule_filter(spark, sf):
    """Prefix inclusion, group exclusion."""
    only = engine.RuleFilter(include=("DML1*",), exclude_groups=("dml-performance",))
    return engine.violations(_asts(spark, sf, corpus.MAIN), engine.select_rules(CORE, only, all_enabled=True)).select("file_path", "rule_id")


@query
def statement_kinds(spark, sf):
    """Kind and place of every statement."""
    return statements(_asts(spark, sf, corpus.LINES)).select("file_path", F.col("stmt_index").cast("long").alias("stmt_index"), "kind", "line", "end_line", F.col("column").alias("col"))


@query
def select_facts(spark, sf):
    """P5, P12-P16, layer B: what is recognised in each select."""
    q = selects(_asts(spark, sf, corpus.CONSTRUCTS))
    return q.select(
        "file_path", "select_id", "depth", "multiplicity", "table_count", "has_wildcard", "is_distinct", "is_union", "is_union_all", "is_intersect", "is_except", "has_limit", "has_offset", "has_fetch", "has_order_by", "has_group_by",
        F.array_join(F.transform("joins", lambda j: F.concat_ws(":", j["join_type"], F.when(j["has_condition"], "on").otherwise("none"))), ",").alias("joins"), F.array_join("projection_kinds", ",").alias("kinds"),
        F.col("where_kind"), F.array_join("cte_names", ",").alias("ctes"), F.array_join(F.transform("window_functions", lambda w: w["name"]), ",").alias("windows"),
    )


@query
def canonical_text(spark, sf):
    """Canonical printing of WHERE and HAVING."""
    return selects(_asts(spark, sf, corpus.CONSTRUCTS)).where("depth = 0").select("file_path", "where_clause", F.col("having").alias("having_text"))


@query
def comment_list(spark, sf):
    """Comments with line and kind."""
    return comments(_asts(spark, sf, corpus.LINES)).select("file_path", F.col("text").alias("comment_text"), "line", "kind")


@query
def explain_json(spark, sf):
    """The parse result as JSON (its first statement's kind is read back)."""
    return explain(_asts(spark, sf, corpus.MAIN)).select("file_path", F.get_json_object("ast_json", "$.statements[0].kind").alias("kind"))


@query
def ast_aggregates(spark, sf):
    """Kinds of each file, flags for created and dropped tables."""
    return file_facts(_asts(spark, sf, corpus.LINES)).select("file_path", F.array_join("kinds", ",").alias("kinds"), "has_create_table", "has_drop_table")


@query
def statement_at_line(spark, sf):
    """The first statement that holds a line."""
    return _asts(spark, sf, corpus.LINES).select("file_path", F.expr(f"{statement_at(2)}.kind").alias("kind"), F.expr(f"{statement_at(2)}.line").alias("line"))


@query
def line_range_text(spark, sf):
    """Lines 2 to 3 of every document."""
    return table(spark, sf, "documents").select("doc_id", line_range(F.col("text"), 2, 3).alias("lines"))


@query
def text_slices(spark, sf):
    """Characters from line 1, column 5 up to line 3, column 9."""
    return table(spark, sf, "documents").select("doc_id", text_slice(F.col("text"), 1, 5, 3, 9).alias("part"))


@query
def line_endings(spark, sf):
    """Line-ending findings on documents with injected carriage returns."""
    m = F.col("doc_id") % 4
    text = F.when(m == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(m == 1, F.replace("text", F.lit("\n"), F.lit("\r"))).when(m == 2, F.concat(F.lit("a\r\nb\rc\n"), F.col("text"))).otherwise(F.col("text"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.lit("sql").alias("script_type"), text.cast("binary").alias("content"))
    return files.file_checks(rows).select("file_path", "rule_id", "severity", "message", "line")


@query
def encodings(spark, sf):
    """Byte order marks and invalid UTF-8."""
    m = F.col("doc_id") % 7
    mark = lambda h: F.concat(F.unhex(F.lit(h)), F.encode(F.lit("x"), "UTF-8"))
    raw = F.when(m == 0, mark("EFBBBF")).when(m == 1, mark("FFFE0000")).when(m == 2, mark("0000FEFF")).when(m == 3, mark("FFFE")).when(m == 4, mark("FEFF")).when(m == 5, F.concat(F.encode(F.lit("ab"), "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode(F.lit("ok"), "UTF-8"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.lit("sql").alias("script_type"), raw.alias("content"))
    return files.file_checks(rows).select("file_path", "rule_id", "message", "line")


@query
def classification(spark, sf):
    """Script type by priority and glob."""
    path = F.concat_ws("/", F.lit("sql"), "lang", "source", F.concat("doc_id", F.lit(".sql")))
    rules = [("**/en/**", "dml", 5), ("**/src1/*.sql", "ddl", 10), ("**/*7.sql", "mixed", 7)]
    return table(spark, sf, "documents").select("doc_id", files.classify(path, rules).alias("script_type"))


@query
def directories(spark, sf):
    """C4: missing and unexpected folders."""
    found = table(spark, sf, "documents").select(F.concat_ws("/", "lang", "source").alias("path")).unionByName(table(spark, sf, "documents").select(F.col("lang").alias("path")))
    required = table(spark, sf, "nation").select(F.concat(F.lit("en/src"), "n_nationkey").alias("path"))
    return files.directory_issues(found, required, ("de/", "fr/src1"), strict=True)


@query
def statement_type_map(spark, sf):
    """Script types of mapper statements by tag."""
    m = mapper.as_scripts(mapper.mapper_sql(corpus.mappers(spark, sf)), {"delete": "cleanup"})
    return m.select("file_path", "statement_id", "script_type", "line_offset")


@query
def identifiers(spark, sf):
    """Identifier functions over generated names."""
    m = F.col("p_partkey") % 6
    name = F.when(m == 0, F.concat(F.lit('s."'), F.col("p_brand"), F.lit('"'))).when(m == 1, F.lit("`order`")).when(m == 2, F.concat(F.lit("pg_"), F.col("p_partkey"))).when(m == 3, F.col("p_name")).when(m == 4, F.lit("schema.Table")).otherwise(F.concat(F.lit("col_"), F.col("p_size")))
    rows = table(spark, sf, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", *[idents.column(f, "name").alias(f) for f in idents.FUNCTIONS])


@query
def placeholder_text(spark, sf):
    """Placeholder normalisation."""
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("SELECT ${a.b} FROM ${} WHERE x = #{id,jdbcType=INT} AND k = "), F.col("c_custkey").cast("string"), F.lit(" #{open")).alias("sql"))
    return _text_udf(rows, "sql", normalize_placeholders).select("c_custkey", "sql")


def _text_udf(rows: DataFrame, column: str, f: Callable[[str], str]) -> DataFrame:
    fn = F.pandas_udf(lambda s: s.map(f), "string")
    return rows.withColumn(column, fn(column))


@query
def repaired_text(spark, sf):
    """Stray commas of dynamic SQL."""
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("UPDATE t SET , a = '(,' , WHERE x IN (, 1, 2 ,) AND k = "), F.col("c_custkey").cast("string")).alias("sql"))
    return _text_udf(rows, "sql", repair_artifacts).select("c_custkey", "sql")


@query
def rewritten_text(spark, sf):
    """Oracle-style text to PostgreSQL spelling."""
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("SELECT NVL(a, SYSDATE) FROM dual MINUS SELECT `b``c`, 'NVL(' FROM t -- MINUS SELECT\n; ALTER TABLE t ADD (x INT, y DECIMAL(3,1)); ALTER TABLE t ADD CONSTRAINT c PRIMARY KEY USING INDEX i"), F.col("s_suppkey").cast("string")).alias("sql"))
    return _text_udf(rows, "sql", lambda x: rewrite_oracle_style(x)[0]).select("s_suppkey", "sql")


@query
def top_level_words(spark, sf):
    """Words outside brackets."""
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("UPDATE t SET a = (SELECT max(b) FROM c ORDER BY d) WHERE k = "), F.col("s_suppkey").cast("string"), F.lit(" GROUP BY x")).alias("words"))
    return _text_udf(rows, "words", lambda x: " ".join(top_words(tokenize(x)))).select("s_suppkey", "words")


@query
def comma_joins(spark, sf):
    """Files with a comma join."""
    return _asts(spark, sf, corpus.MAIN).select("file_path", F.col("ast.has_comma_join_anywhere").alias("has_comma_join"))


@query
def placeholder_probe(spark, sf):
    """Placeholders, longest IN list, CREATE TABLE AS."""
    n = (F.col("c_custkey") % 5 + 1).cast("int")
    marks = F.array_join(F.array_repeat(F.lit("?"), n), ", ")
    sql = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("CREATE TABLE x (a) AS ")).otherwise(F.lit("")), F.lit("SELECT a FROM t WHERE a = ? AND b = '?' AND c IN ("), marks, F.lit(") -- ?"))
    return replay.probe(table(spark, sf, "customer").select("c_custkey", sql.alias("sql"))).select("c_custkey", "placeholders", "in_params", "ctas")


@query
def values_and_sets(spark, sf):
    """Tuples of VALUES and columns of SET, as used by rollback."""
    templates = [("dml", "INSERT INTO t (id, n) VALUES ({k}, 'a,b'), (2, f(1, 2))"), ("dml", "UPDATE t SET a = 1, t.b = (SELECT 2) WHERE id = {k}")]
    o = rollback.Options(primary_keys=(("t", ("id",)),))
    return rollback.pairs(_asts(spark, sf, templates), o).select("file_path", "rollback", "reliable", "review_level")


@query
def hunk_violations(spark, sf):
    """Ranges of lines that touch a changed range (semi join on path and overlap)."""
    v = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("file_path"), (F.col("l_linenumber") * 10).cast("long").alias("line"), (F.col("l_linenumber") * 10 + 5).cast("long").alias("end_line"), F.col("l_linenumber").alias("rule_id"))
    o = table(spark, sf, "orders").where("o_orderkey % 3 <> 0")
    start = (F.col("o_orderkey") % 60).cast("long")
    hunks = o.select(F.col("o_orderkey").cast("string").alias("path"), F.lit("new").alias("side"), start.alias("start_line"), (start + 4).alias("end_line"), (F.col("o_orderkey") % 7 == 0).alias("is_new"))
    return engine.in_hunks(v, hunks).select("file_path", "rule_id", "line")


@query
def diff_hunks(spark, sf):
    """Hunks from diff text."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    lines = F.array_compact(F.array(
        F.concat(F.lit("diff --git a/"), s, F.lit(".sql b/"), s, F.lit(".sql")), F.when(k % 3 == 0, F.lit("new file mode 100644")), F.lit("--- a/x"), F.concat(F.lit("+++ b/"), s, F.lit(".sql")),
        F.when(k % 3 == 0, F.lit("@@ -0,0 +1,4 @@")).otherwise(F.concat(F.lit("@@ -"), (k % 50).cast("string"), F.lit(" +"), (k % 40).cast("string"), F.lit(",3 @@ fn"))), F.lit("+++ b/not a header"), F.when(k % 2 == 0, F.lit("@@ -90,2 +95,0 @@")),
    ))
    rows = table(spark, sf, "orders").select(s.alias("diff_id"), F.posexplode(lines).alias("line_no", "line"))
    return diff.parse_diff(rows).select("path", "side", "start_line", "end_line", "is_new")


@query
def mapper_statements(spark, sf):
    """Statements of XML mappers and their renderings."""
    m = mapper.mapper_sql(corpus.mappers(spark, sf))
    return m.select("file_path", "statement_id", "statement_type", "raw_xml_line", "sql_all", "sql_first", "has_dynamic", "has_dollar", "n_ifs", F.size("variants").alias("n_variants"))


@query
def mapper_variants(spark, sf):
    """M4, M5: expanded variants."""
    m = mapper.mapper_sql(corpus.mappers(spark, sf))
    return m.select("statement_id", F.posexplode("variants").alias("k", "v")).select("statement_id", "k", F.col("v.sql").alias("sql"))


@query
def mapper_violations(spark, sf):
    """Rules over mapper statements, with lines of the XML file."""
    scripts = mapper.as_scripts(mapper.mapper_sql(corpus.mappers(spark, sf)))
    return engine.check(scripts, engine.select_rules()).select("file_path", "rule_id", "line")


@query
def mapper_failures(spark, sf):
    """M9: why mapper statements do not parse."""
    return mapper.failures(mapper.mapper_sql(corpus.broken_mappers(spark, sf)))


@query
def mapper_includes(spark, sf):
    """Fragments of other files and namespaces, two steps away."""
    m = mapper.mapper_sql(corpus.including_mappers(spark, sf))
    return m.select("file_path", "statement_id", "raw_xml_line", "sql_all")


@query
def mapper_lines(spark, sf):
    """Rules report lines of the XML file."""
    m = mapper.mapper_sql(corpus.including_mappers(spark, sf), across_files=False)
    return engine.check(mapper.as_scripts(m), [BY_ID["DML002"]]).where("rule_id = 'DML002'").select("file_path", "rule_id", "line", "end_line")


@query
def relation_edges(spark, sf):
    """Join edges with resolved aliases."""
    return relations.edges(_asts(spark, sf, corpus.JOINS)).select("file_path", "left_table", "left_column", "right_table", "right_column", "join_type")


@query
def relation_list(spark, sf):
    """Undirected relations with direction hints."""
    return relations.relations(relations.edges(_asts(spark, sf, corpus.JOINS)))


@query
def relation_stats(spark, sf):
    """N7."""
    return relations.stats(relations.relations(relations.edges(_asts(spark, sf, corpus.JOINS))))


@query
def relation_changed(spark, sf):
    """Evidence in changed ranges."""
    e = relations.edges(_asts(spark, sf, corpus.JOINS))
    hunks = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("o/"), "o_orderkey", F.lit(".sql")).alias("path"), F.lit("new").alias("side"), F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"), F.lit(False).alias("is_new"))
    return engine.in_hunks(e, hunks).select("file_path", "left_column", "right_column")


@query
def replay_manifest(spark, sf):
    """Replayable statements of scripts."""
    return replay.script_statements(_asts(spark, sf, corpus.LINES), ("select", "insert", "update", "delete", "ddl")).select("id", "type", "line", "end_line", "sql")


@query
def replay_mapper(spark, sf):
    """Mapper variants in the manifest."""
    return replay.mapper_statements(mapper.mapper_sql(corpus.mappers(spark, sf))).select("id", "type", "variant_of", "parse_error")


@query
def replay_changed(spark, sf):
    """Added and modified statements."""
    s = replay.script_statements(_asts(spark, sf, corpus.LINES))
    k = F.col("o_orderkey")
    hunks = table(spark, sf, "orders").where("o_orderkey % 5 <> 0").select(F.concat(F.lit("o/"), k, F.lit(".sql")).alias("path"), F.lit("new").alias("side"), F.lit(2).cast("long").alias("start_line"), F.lit(2).cast("long").alias("end_line"), (k % 5 == 1).alias("is_new"))
    return replay.changed(s, hunks).select("id", "change")


@query
def replay_removed(spark, sf):
    """Removed statements."""
    old = replay.script_statements(_asts(spark, sf, corpus.LINES))
    new = old.where(~F.endswith("id", F.lit("#2")))
    hunks = table(spark, sf, "orders").select(F.concat(F.lit("o/"), "o_orderkey", F.lit(".sql")).alias("path"), F.lit("old").alias("side"), F.lit(2).cast("long").alias("start_line"), F.lit(3).cast("long").alias("end_line"), F.lit(False).alias("is_new"))
    return replay.removed(old, new, hunks).select("id", "type")


@query
def replay_routing(spark, sf):
    """What is executed and why not."""
    return replay.routing(replay.script_statements(_asts(spark, sf, corpus.MAIN))).select("id", "action", "reason")


@query
def parameter_findings(spark, sf):
    """Placeholders without parameters."""
    sql = F.concat(F.lit("SELECT a FROM t WHERE a = ? AND b IN ("), F.array_join(F.array_repeat(F.lit("?"), F.when(F.col("c_custkey") % 50 == 0, 1001).otherwise(2)), ","), F.lit(")"))
    c = table(spark, sf, "customer")
    s = c.select(F.col("c_custkey").cast("string").alias("id"), sql.alias("sql"))
    return replay.parameter_findings(s, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("stmt_id"))).select("stmt_id", "code")


@query
def replay_report(spark, sf):
    """Summary of results."""
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "skipped").otherwise("ok")
    level = F.when(F.col("value") > 100, "error").when(F.col("value") > 10, "warn").otherwise("none")
    return replay.report_summary(e.select(F.col("event_id").alias("stmt_id"), status.alias("status"), level.alias("level"), (F.col("event_id") % 3).alias("n_findings")))


@query
def plan_tree(spark, sf):
    """A1: nodes of JSON plans."""
    k = F.col("o_orderkey").cast("string")
    plan = F.concat(F.lit('[{"Plan": {"Node Type": "Nested Loop", "Plan Rows": '), k, F.lit(', "Plans": [{"Node Type": "Seq Scan", "Relation Name": "orders", "Plan Rows": '), k, F.lit(', "Actual Rows": 3}, {"Node Type": "Index Scan", "Index Name": "i", "Total Cost": 1.5, "Plan Rows": 1}]}}]'))
    nodes = plan_findings.plan_nodes(table(spark, sf, "orders").select(k.alias("stmt_id"), plan.alias("plan_json")))
    return nodes.select("stmt_id", "parent_id", "child_idx", "node_type", "relation", "index_name", "total_cost", "plan_rows", "has_actual")


def _plan_rows(spark, sf) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("Seq Scan", "Nested Loop", "Sort", "Bitmap Heap Scan", "Streaming(type: REDISTRIBUTE)")])
    n = F.col("l_linenumber") - 1
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("stmt_id"), n.alias("node_id"), (n - 1).alias("parent_id"), F.lit(0).alias("child_idx"), F.element_at(kinds, (n % 5 + 1).cast("int")).alias("node_type"), F.col("l_returnflag").alias("relation"),
        (F.col("l_quantity") * 5000).cast("long").alias("plan_rows"), F.col("l_suppkey").alias("actual_rows"), (F.col("l_linestatus") == "F").alias("has_actual"),
    )


@query
def plan_findings_pg(spark, sf):
    """A3-A7."""
    return plan_findings.findings(_plan_rows(spark, sf)).select("stmt_id", "code", "node_id", "node_type")


@query
def plan_findings_mysql(spark, sf):
    """A2, A8."""
    k = F.col("l_linenumber")
    row = F.concat(F.lit('{"type": "'), F.when(k % 2 == 0, "ALL").otherwise("ref"), F.lit('", "table": "t", "key": '), F.when(k % 3 == 0, F.lit("null")).otherwise(F.lit('"i"')), F.lit(', "rows": '), (F.col("l_quantity") * 1000).cast("long").cast("string"), F.lit(', "Extra": "'), F.when(k % 4 == 0, "Using filesort").when(k % 4 == 1, "Using temporary").otherwise(""), F.lit('"}'))
    plans = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("stmt_id"), F.concat(F.lit("["), row, F.lit("]")).alias("plan_json"))
    return plan_findings.mysql_findings(plan_findings.mysql_plan_nodes(plans)).select("stmt_id", "code")


@query
def timing_stats(spark, sf):
    """Timing statistics and slow levels."""
    t = table(spark, sf, "events").select("user_id", (F.col("value") * 10).alias("ms"))
    out = plan_findings.timing_stats(t, ["user_id"])
    return out.select("user_id", "n", *[F.round(c, 4).alias(c) for c in ("min_ms", "p50_ms", "p99_ms", "avg_ms")], "level")


@query
def rollback_pairs(spark, sf):
    """Safety of every statement of the main corpus."""
    p = rollback.pairs(_asts(spark, sf, corpus.MAIN))
    return p.select("file_path", "stmt_kind", "target_table", F.col("backup").isNotNull().alias("has_backup"), F.col("rollback").isNotNull().alias("has_rollback"), "reliable", "partial", "irreversible", "counter_unrestored", "requires_lock", "lock_type", "review_level")


@query
def rollback_sql(spark, sf):
    """Rollback text of metadata changes and simple DDL, PostgreSQL."""
    templates = [("ddl", "CREATE TABLE T{k} (id INT)"), ("ddl", "ALTER TABLE t ADD COLUMN x{k} INT, RENAME COLUMN a TO b, ADD CONSTRAINT fk FOREIGN KEY (a) REFERENCES c (d)"), ("ddl", "ALTER TABLE t RENAME TO u{k}"), ("ddl", "CREATE VIEW v{k} AS SELECT 1"), ("ddl", "CREATE INDEX i{k} ON t (a)")]
    return rollback.pairs(_asts(spark, sf, templates), rollback.Options(dialect="postgresql")).select("file_path", "rollback")


@query
def rollback_texts(spark, sf):
    """Whole backup and rollback texts in three dialects."""
    asts = _asts(spark, sf, [("ddl", "DROP TABLE t{k}"), ("ddl", "ALTER TABLE t{k} DROP COLUMN c"), ("dml", "TRUNCATE TABLE t{k}"), ("dml", "DELETE FROM t{k} WHERE a = 1")])
    before, out = rollback.numbers(asts), None
    for dialect in ("mysql", "postgresql", "gaussdb"):
        found = rollback.pairs(asts, rollback.Options(dialect=dialect), before).select("file_path", F.lit(dialect).alias("dialect"), F.rtrim("backup", F.lit("\n")).alias("backup_sql"), F.rtrim("rollback", F.lit("\n")).alias("rollback_sql"))
        out = found if out is None else out.unionByName(found)
    return out


@query
def rollback_replace(spark, sf):
    """REPLACE as a kind of its own."""
    asts = _asts(spark, sf, [("dml", "REPLACE INTO t (id, n) VALUES ({k}, 'x'), (2, 'y')"), ("dml", "REPLACE INTO u (id) VALUES ({k})")])
    o = rollback.Options(dialect="postgresql", replace_kind=True, primary_keys=(("t", ("id",)),))
    found = rollback.pairs(asts, o)
    rows = F.regexp_extract("backup", r"SELECT \* FROM ([^;]*);", 1)
    return found.select("file_path", "stmt_kind", rows.alias("old_rows"), "partial", "reliable", "requires_lock", F.element_at(F.split("warnings", "; "), 1).alias("warning"))


@query
def rollback_names(spark, sf):
    """Numbers and backup names over the whole corpus."""
    return rollback.pairs(_asts(spark, sf, corpus.MAIN)).where("backup_table is not null").select("file_path", "seq", "backup_table")


@query
def rollback_manifest(spark, sf):
    """B15, B16."""
    return rollback.manifest(rollback.pairs(_asts(spark, sf, corpus.MAIN)))


@query
def lock_groups(spark, sf):
    """Neighbouring full backups of one table share a lock."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("file_path"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long").alias("seq"), F.when(F.col("l_quantity") > 5, "b").alias("backup"), F.col("l_returnflag").alias("target_table"),
        F.when(F.col("l_linestatus") == "O", "full").otherwise("incremental").alias("backup_mode"),
    )
    return rollback.coalesced(rows).select("file_path", "seq", "lock_group")


@query
def rollback_scripts(spark, sf):
    """Rollback in reverse order."""
    templates = [("ddl", "CREATE TABLE a{k} (id INT); CREATE VIEW b{k} AS SELECT 1"), ("dml", "SELECT 1")]
    s = rollback.scripts(rollback.pairs(_asts(spark, sf, templates)))
    return s.select("file_path", F.regexp_replace("rollback_sql", r"-- seq=\d+ ", "").alias("rollback_sql"))


@query
def rollback_review(spark, sf):
    """Statements to review."""
    return rollback.review(rollback.pairs(_asts(spark, sf, corpus.MAIN))).groupBy("review_level", "stmt_kind").agg(F.count(F.lit(1)).alias("n"))


@query
def report_lines(spark, sf):
    """O1: lines of the plain report."""
    return reports.plain_lines(engine.violations(_asts(spark, sf, corpus.MAIN), engine.select_rules()))


@query
def report_summary(spark, sf):
    """Counts and whether the run passed."""
    found = engine.violations(_asts(spark, sf, corpus.MAIN), engine.select_rules())
    return reports.summary(found).select("passed", "total", "errors", "warnings")


@query
def report_by_rule(spark, sf):
    """Counts by group and rule with totals."""
    return reports.by_rule(engine.violations(_asts(spark, sf, corpus.MAIN), engine.select_rules()))


@query
def exit_status(spark, sf):
    """O6."""
    return engine.exit_status(engine.violations(_asts(spark, sf, corpus.MAIN), engine.select_rules()))


@query
def cache_misses(spark, sf):
    """K1: files whose time or size changed."""
    d = table(spark, sf, "documents")
    at = lambda s: F.timestamp_seconds(s)
    now = d.select(F.col("doc_id").cast("string").alias("file_path"), at(F.col("doc_id") * 10).alias("mtime"), F.col("n_chars").alias("size"))
    then = d.where("doc_id % 5 <> 0").select(F.col("doc_id").cast("string").alias("file_path"), (F.col("doc_id") * 10).alias("mtime_sec"), (F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("size"), F.lit("x").alias("rule_id"))
    misses, _ = reports.cache_split(now, then)
    return misses.select("file_path", "size")


@query
def lock_file(spark, sf):
    """Checksums of files."""
    from plumbline.operators.packs import lock

    return lock(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")))
