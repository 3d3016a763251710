import json

import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators import engine, incremental, packs, plan_findings, relations, replay, reports, rollback
from plumbline.operators.parse import parse_scripts
from plumbline.operators.rules import ALL, BY_ID, CORE, GAUSS, user_rule
from plumbline.sources import diff, files, mapper
from plumbline.streaming import check_stream


def scripts(spark, *rows):
    return spark.createDataFrame([r if len(r) == 3 else (*r, None) for r in rows], schemas.SCRIPTS)


def hits(spark, sql, kind="dml", rules=None, **options):
    found = engine.check(scripts(spark, ("f.sql", kind, sql)), engine.select_rules(all_enabled=True) if rules is None else rules, **options)
    return sorted((r.rule_id, r.line) for r in found.collect())


def test_all_rules_are_there():
    assert len(CORE) == 25 and len(GAUSS) == 18 and len({r.id for r in ALL}) == 43
    assert {r.id for r in CORE if not r.enabled} == {"DML101", "DML102", "DML103", "DML104", "DML105", "DML106", "DML107"}


@pytest.mark.parametrize(
    "rule, bad, good",
    [
        ("DML004", "SELECT a FROM (SELECT a FROM t)", "SELECT a FROM (SELECT a FROM t) s"),
        ("DML006", "SELECT a.x FROM a JOIN b", "SELECT a.x FROM a CROSS JOIN b"),
        ("DML102", "WITH c AS (SELECT 1 x) SELECT a FROM t", "WITH c AS (SELECT 1 x) SELECT a FROM c"),
        ("DML107", "SELECT CASE WHEN a THEN CASE WHEN b THEN 1 END END FROM t", "SELECT CASE WHEN a THEN 1 END FROM t"),
        ("DML108", "SELECT a FROM t WHERE 'x' = 'x'", "SELECT a FROM t WHERE a = 'x'"),
        ("DML108", "DELETE FROM t WHERE TRUE", "DELETE FROM t WHERE a"),
        ("DML110", "SELECT a.x FROM a, b, c, d, e, f", "SELECT a.x FROM a, b, c, d, e"),
        ("DML111", "UPDATE t SET a = 1 WHERE b = 1 OR c = 2", "UPDATE t SET a = 1 WHERE b = ' OR ' ORDER BY c"),
        ("gaussdb:GDML002", "UPDATE t SET a = 1 WHERE b = 2 ORDER BY c", "UPDATE t SET a = (SELECT b FROM c ORDER BY b) WHERE d = 1"),
        ("gaussdb:GDML004", "UPDATE t SET a = 1 WHERE b IN (SELECT c FROM d)", "UPDATE t SET a = (SELECT 1) WHERE b = 1"),
        ("gaussdb:GPERF001", "SELECT a FROM t WHERE b = '" + "x" * 5200 + "'", "SELECT a FROM t"),
    ],
)
def test_rules(spark, rule, bad, good):
    assert hits(spark, bad, rules=[BY_ID[rule]]) == [(rule, 1)] and hits(spark, good, rules=[BY_ID[rule]]) == []


@pytest.mark.parametrize(
    "rule, bad, good",
    [
        ("gaussdb:GNAM001", "CREATE TABLE s.t (id INT)", "CREATE TABLE t (id INT)"), ("gaussdb:GNAM004", f"CREATE TABLE {'x' * 64} (id INT)", f"CREATE TABLE {'x' * 63} (id INT)"),
        ("gaussdb:GTYP001", "CREATE TABLE t (" + ", ".join(f"c{i} TEXT" for i in range(9)) + ")", "CREATE TABLE t (c VARCHAR(2000), d VARCHAR(10))"), ("gaussdb:GOBJ003", "CREATE VIEW v AS SELECT a FROM t", "CREATE MATERIALIZED VIEW v AS SELECT a FROM t"),
        ("gaussdb:GDDL001", "BEGIN; DROP TABLE t", "BEGIN; DROP TABLE t; COMMIT"), ("gaussdb:GDDL001", "COMMIT; BEGIN; CREATE INDEX i ON t (a)", "BEGIN; SELECT 1"),
    ],
)
def test_ddl_rules(spark, rule, bad, good):
    assert [r for r, _ in hits(spark, bad, "ddl", [BY_ID[rule]])] == [rule] and hits(spark, good, "ddl", [BY_ID[rule]]) == []


def test_params_filter_and_scope(spark):
    rule = BY_ID["DML110"].with_params(max_join_tables=1)
    assert hits(spark, "SELECT a.x FROM a, b", rules=[rule]) == [("DML110", 1)] and hits(spark, "SELECT a.x FROM a, b", "ddl", [rule]) == []
    f = engine.RuleFilter(include=("DML*", "gaussdb:GD*"), exclude=("DML001",))
    names = {r.id for r in engine.select_rules(only=f, all_enabled=True)}
    assert "DML002" in names and "DML001" not in names and "gaussdb:GDML002" in names and "gaussdb:GNAM001" not in names and "DDL001" not in names
    assert engine.RuleFilter(include=("GNAM001",)).matches("gaussdb:GNAM001", None)


def test_exemptions_and_dynamic(spark):
    sql = "-- lint-disable-next-line dml001,DML002 */ DML003\nSELECT * FROM t;\nDELETE FROM a /* lint-disable DML00* */;\nSELECT * FROM b"
    assert hits(spark, sql, rules=[BY_ID["DML001"], BY_ID["DML002"]]) == [("DML001", 4)]
    assert hits(spark, "SELECT * FROM t -- check-disable-line *", rules=[BY_ID["DML001"]], marker="check") == []
    assert hits(spark, "SELEC ${x}", rules=[], trust_dynamic=True) == [("DYN", 1)] and hits(spark, "SELEC ${x}", rules=[]) == [("PARSE", 1)]


def test_null_and_empty_scripts(spark):
    assert engine.check(scripts(spark, ("a", "dml", None), ("b", None, "SELECT * FROM t"), ("c", "dml", ""))).count() == 0
    assert engine.check(scripts(spark, ("a", "dml", "")).limit(0)).count() == 0


def test_a_run_of_rules_has_no_shuffle(spark, tmp_path):
    path = str(tmp_path / "s")
    scripts(spark, *[(f"{i}", "dml", "SELECT * FROM t") for i in range(40)]).repartition(16).write.parquet(path)
    plan = engine.check(spark.read.schema(schemas.SCRIPTS).parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Join" not in plan  # one round-robin if the scan has fewer splits than cores


def test_distinct_text_gives_the_same(spark):
    s = scripts(spark, ("a", "dml", "SELECT * FROM t"), ("b", "dml", "SELECT * FROM t"), ("c", "dml", "DELETE FROM t"))
    one, two = (sorted(engine.violations(parse_scripts(s, distinct_text=d), engine.select_rules()).collect()) for d in (False, True))
    assert one == two and len(one) == 3


def test_files(spark, tmp_path):
    for name, raw in {"sql/ddl/a.sql": b"CREATE TABLE t (id INT);\r\n", "sql/dml/b.SQL": "SELECT 'é'".encode(), "vendor/c.sql": b"x", "sql/d.txt": b"x", "sql/dml/e.sql": b"\xff\xfeS\x00", "sql/dml/g.sql": b"ab\xff", "sql/dml/h.sql": b"\xef\xbb\xbfSELECT 1"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)
    rules = [("**/ddl/**", "ddl", 10), ("**/dml/**", "dml", 10)]
    got = {r.file_path.rsplit("/", 1)[1]: (r.script_type, r.text) for r in files.scripts(spark, str(tmp_path), rules).collect()}
    assert got == {"a.sql": ("ddl", "CREATE TABLE t (id INT);\r\n"), "b.SQL": ("dml", "SELECT 'é'"), "e.sql": ("dml", "S"), "g.sql": ("dml", None), "h.sql": ("dml", "SELECT 1")}
    checks = files.file_checks(files.scan(spark, str(tmp_path)).withColumn("script_type", F.lit("sql")))
    assert sorted((r.file_path.rsplit("/", 1)[1], r.rule_id) for r in checks.collect()) == [("a.sql", "FILE002"), ("e.sql", "FILE001"), ("g.sql", "FILE001"), ("h.sql", "FILE001")]
    gbk = files.decode(spark.createDataFrame([("a", "中".encode("gbk")), ("b", b"\xff")], "file_path string, content binary"), "gbk").orderBy("file_path").collect()
    assert [r.text for r in gbk] == ["中", None]
    with pytest.raises(ValueError):
        files.validate_encoding("no-such")


def test_diff_of_a_repository(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.sql").write_text("one\ntwo\nthree\n")
    run("add", ".")
    run("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x")
    (tmp_path / "a.sql").write_text("one\n2\n2b\nthree\n")
    (tmp_path / "new.sql").write_text("x")
    got = sorted((r.path, r.side, r.start_line, r.is_new) for r in diff.git_hunks(spark, str(tmp_path), "HEAD").collect())
    assert got == [("a.sql", "new", 2, False), ("a.sql", "old", 2, False), ("new.sql", "new", 1, True)]
    assert [r.text for r in diff.git_show(spark, str(tmp_path), "HEAD", ["a.sql", "none.sql"]).collect()] == ["one\ntwo\nthree\n", None]
    for bad in ("", "-x"):
        with pytest.raises(ValueError):
            diff.validate_base(bad)


def test_mapper_across_files(spark):
    rows = [("a.xml", '<mapper namespace="a"><sql id="base">x, <include refid="b.more"/></sql></mapper>'), ("b.xml", '<mapper namespace="b"><sql id="more">y</sql></mapper>'),
            ("c.xml", '<mapper namespace="c">\n<select id="s">SELECT <include refid="a.base"/> FROM t\n<where><if test="p">AND p = #{p}</if></where></select></mapper>'), ("bad.xml", "<mapper"), ("none.xml", None)]
    got = mapper.mapper_sql(spark.createDataFrame(rows, "file_path string, text string")).collect()
    assert [(r.statement_id, r.sql_all, r.raw_xml_line, r.n_ifs) for r in got] == [("c.s", "SELECT x, y FROM t WHERE p = ?", 2, 1)]


def test_variants_are_bounded():
    ifs = lambda n: '<mapper namespace="m"><select id="s">SELECT 1 FROM t ' + "".join(f'<if test="c{i}">AND c{i} = 1 </if>' for i in range(n)) + "</select></mapper>"
    assert len(mapper.extract(ifs(8))[0]["variants"]) == 256 and len(mapper.extract(ifs(9))[0]["variants"]) == 10
    with pytest.raises(ValueError):
        mapper.read_tree('<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')


def test_rollback_texts(spark):
    sql = "DROP TABLE Orders;\nTRUNCATE TABLE t;\nINSERT INTO t (a, b) VALUES (1, DEFAULT);\nDELETE FROM t WHERE a = 1;\nMERGE INTO a USING b ON a.i = b.i;\nBEGIN;\nALTER TABLE t DROP COLUMN x"
    p = {r.seq: r for r in rollback.pairs(parse_scripts(scripts(spark, ("f.sql", "ddl", sql)))).collect()}
    assert p[1].backup.startswith("-- schema check") and "INSERT INTO `bks_Orders_20240101_0001` SELECT * FROM `Orders`;" in p[1].backup and "CREATE TABLE `Orders` LIKE `bks_Orders_20240101_0001`;" in p[1].rollback and p[1].irreversible_if_backup_missing
    assert (p[2].reliable, p[2].counter_unrestored, p[2].review_level, p[2].lock_type) == (True, True, "optional", "FTWRL")
    assert p[3].rollback == "DELETE FROM `t` WHERE `a` = 1;" and not p[3].reliable
    assert p[4].backup.count("SELECT * FROM `t` WHERE a = 1;") == 1 and p[4].reliable
    assert p[5].irreversible and not p[6].irreversible and not p[6].reliable and p[7].partial
    assert "RENAME TABLE `t` TO `t_old_0007`, `_rb_0007_t` TO `t`;" in p[7].rollback
    s = rollback.scripts(rollback.pairs(parse_scripts(scripts(spark, ("f.sql", "ddl", sql)))), rollback.Options(lock_scope="none")).collect()[0]
    assert "FLUSH TABLES" not in s.backup_sql and s.rollback_sql.index("seq=7") < s.rollback_sql.index("seq=1 ")
    o = rollback.Options(dialect="postgresql")
    pg = rollback.scripts(rollback.pairs(parse_scripts(scripts(spark, ("f.sql", "ddl", sql))), o), o).collect()[0]
    assert pg.rollback_sql.startswith("BEGIN;") and "INCLUDING DEFAULTS" in pg.rollback_sql
    assert "check" in rollback.long_transaction_check("mysql") and rollback.review_html(rollback.pairs(parse_scripts(scripts(spark, ("f.sql", "ddl", sql))))).count("<tr>") >= 7


def test_reports(spark, tmp_path):
    found = engine.check(scripts(spark, ("b.sql", "dml", "SELECT * FROM t"), ("a.sql", "ddl", "DROP TABLE t; CREATE TABLE u (id INT)")))
    doc = json.loads(reports.sarif(found, missing=("x",)))
    run = doc["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["DDL001", "DDL002", "DML001", "STRUCT001"] and run["results"][2]["ruleIndex"] == 2
    lines = [r.line for r in reports.plain_lines(found).collect()]
    assert lines[0].startswith("[WARNING] a.sql") and len(lines) == 3
    assert "<td>DML001</td>" in reports.html_report(found) and len(reports.write_reports(found, str(tmp_path), ("plain", "json", "html", "sarif"))) == 4
    reports.write_json(found, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert engine.exit_status(found).first().failed and not engine.exit_status(found.where("severity = 'warning'")).first().failed


def test_cache(spark, tmp_path):
    f = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:00:00", 2)], "file_path string, mtime string, size long").withColumn("mtime", F.to_timestamp("mtime"))
    found = engine.check(scripts(spark, ("a", "dml", "SELECT * FROM t")))
    reports.cache_write(reports.cache_rows(f, found), str(tmp_path / "c"), "sig")
    cached = spark.read.parquet(str(tmp_path / "c")).where("run_signature = 'sig'")
    misses, hits_ = reports.cache_split(f.withColumn("size", F.when(F.col("file_path") == "b", 3).otherwise(F.col("size"))), cached)
    assert [r.file_path for r in misses.collect()] == ["b"] and hits_.where("rule_id is not null").count() == 1
    again = f.where("file_path = 'a'").withColumn("size", F.lit(9).cast("long"))
    for _ in range(2):  # a file that is checked again takes the place of its rows
        reports.cache_write(reports.cache_rows(again, found), str(tmp_path / "c"), "sig")
    assert sorted((r.file_path, r["size"], r.rule_id) for r in reports.cache_read(spark, str(tmp_path / "c"), "sig").collect()) == [("a", 9, "DML001"), ("b", 2, None)]
    assert reports.cache_read(spark, str(tmp_path / "c"), "other") is None


def test_paths_of_a_diff_match_by_their_ends(spark):
    paths = spark.createDataFrame([(p,) for p in ("/w/repo/sql/a.sql", "b.sql", "./sub/c.sql", "xa.sql", "win\\d.sql")], "file_path string")
    diff_ = spark.createDataFrame([(p,) for p in ("sql/a.sql", "a.sql", "deep/b.sql", "sub/c.sql", "win/d.sql")], "path string")
    got = {r.file_path: r.path for r in incremental.match_paths(paths, diff_).collect()}
    assert got == {"/w/repo/sql/a.sql": "sql/a.sql", "b.sql": "deep/b.sql", "./sub/c.sql": "sub/c.sql", "win\\d.sql": "win/d.sql"}
    whole = spark.createDataFrame([(".",)], "path string")
    assert incremental.match_paths(paths, whole).count() == 5


def test_check_of_a_diff_with_mappers(spark):
    sql = spark.createDataFrame([("r/a.sql", "dml", b"DELETE FROM a;\nDELETE FROM b;\r\n"), ("r/z.sql", "dml", b"DELETE FROM z")], "file_path string, script_type string, content binary").withColumn("text", F.col("content").cast("string"))
    xml = spark.createDataFrame([("r/m.xml", b'<mapper namespace="m">\n<delete id="d">DELETE FROM t</delete>\n<delete id="e">DELETE FROM u</delete></mapper>')], "file_path string, content binary").withColumn("text", F.col("content").cast("string"))
    hunks = spark.createDataFrame([("a.sql", "new", 2, 2, False), ("m.xml", "new", 3, 3, False)], schemas.HUNKS)
    got = incremental.check_diff(sql, hunks, [BY_ID["DML002"]], xml).collect()
    assert sorted((r.file_path, r.rule_id, r.line) for r in got) == [("r/a.sql", "DML002", 2), ("r/a.sql", "FILE002", 2), ("r/m.xml", "DML002", 3)]


def test_scan_of_mappers(spark, tmp_path):
    for name in ("src/a/mapper/OneMapper.xml", "src/a/mapper/deep/two.xml", "src/b/mapper/x.txt", "src/b/other/three.xml", "node_modules/mapper/n.xml", "lit/four.xml"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("<mapper/>")
    scan = lambda *a, **k: sorted((r.file_path.split("src/")[-1].split("/lit/")[-1], r.entry) for r in mapper.scan(spark, str(tmp_path), *a, **k).collect())
    assert scan(("src/**/mapper", "lit", "src", "none")) == [("a/mapper/OneMapper.xml", 0), ("a/mapper/deep/two.xml", 0), ("b/other/three.xml", 2), ("four.xml", 1)]
    assert scan(("src",), ("*Mapper.xml",)) == [("a/mapper/OneMapper.xml", 0)] and scan(("src/*/other/*.xml",)) == [("b/other/three.xml", 0)] and scan(("none",)) == []


def test_rules_of_a_user(spark, tmp_path):
    (tmp_path / "r.sql").write_text("case when s.kind = 'SELECT' then array(named_struct('message', concat('limit {n}'), 'line', s.line, 'column', s.`column`)) else cast(array() as array<struct<message:string,line:bigint,column:bigint>>) end")
    (tmp_path / "bad.sql").write_text("array(1")
    rules = [user_rule(spark, "U1", str(tmp_path / "r.sql"), params={"n": 3}, group="mine"), user_rule(spark, "U2", str(tmp_path / "bad.sql"), applies_to=("ddl",)), user_rule(spark, "U3", "/none/x.sql", severity="error")]
    found = engine.check(scripts(spark, ("f.sql", "dml", "SELECT 1")), rules).collect()
    assert sorted((r.rule_id, r.severity, r.message, r.line) for r in found) == [("U1", "warning", "limit 3", 1), ("U3", "error", "Rule script not found: /none/x.sql", None)]
    assert engine.check(scripts(spark, ("f.sql", "ddl", "SELECT 1")), rules).where("rule_id = 'U2'").first().message.startswith("Rule execution error: ")


def test_long_literals_do_not_use_the_stack(spark):
    assert hits(spark, "SELECT a FROM t WHERE b = '" + "x''" * 30000 + "' OR c = 1", rules=[BY_ID["DML108"], BY_ID["DML111"]]) == [("DML111", 1)]
    assert hits(spark, "DELETE FROM t WHERE 'it''s'", rules=[BY_ID["DML108"]]) == [("DML108", 1)]


def test_fixtures_are_bound(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"a": ["1", None], "b": []}))
    s = spark.createDataFrame([("a", "SELECT ? + ? + ?"), ("b", "SELECT '?', ?"), ("c", "SELECT 1 -- ?")], "id string, sql string")
    fixtures = replay.read_fixtures(spark, str(tmp_path / "f.json"))
    assert {r.id: (r.has_fixture, r.bound) for r in replay.bind(s, fixtures).collect()} == {"a": (True, ["1", None, None]), "b": (True, [None]), "c": (False, [])}
    assert {r.id: (r.has_fixture, r.bound) for r in replay.bind(s, fixtures, "1").collect()} == {"a": (True, ["1", None, "1"]), "b": (True, ["1"]), "c": (True, [])}


def test_running_numbers_over_many_ranges(spark):
    rows = spark.range(500).selectExpr("concat('f', lpad(cast(id as string), 4, '0')) file_path", "id % 3 n")
    got = {r.file_path: r.n_before for r in rollback.running(rows, ["n"]).collect()}
    assert got == {f"f{k:04}": sum(j % 3 for j in range(k)) for k in range(500)}


def test_pack_listing_vendor_and_add(spark, tmp_path):
    pack = tmp_path / "mine"
    pack.mkdir()
    (pack / "pack.toml").write_text('[pack]\nname = "mine"\nversion = "1.0"\nnamespace = "m"\napi_version = 1\n[[rules]]\nid = "m:A1"\n')
    info = packs.read_pack(str(pack))
    assert info["rule_count"] == 1 and "43 rule(s) effective" in packs.listing([info]) and json.loads(packs.listing([], as_json=True))["rule_count"] == 43
    assert packs.vendor({"mine": str(pack)}, str(tmp_path / "c")) == [str(tmp_path / "c/vendor/rules/mine")] and (tmp_path / "c/vendor/rules/mine/pack.toml").exists()
    config = tmp_path / "config.toml"
    assert 'name = "mine"' in packs.add(str(pack), str(config)) and "other" in packs.add("other@2.1", str(config))
    for bad in ("mine", "Bad Name"):
        with pytest.raises(ValueError):
            packs.add(bad, str(config))
    with pytest.raises(ValueError):
        packs.vendor({}, str(tmp_path))


def test_packs(spark, tmp_path):
    rules, notes = packs.merge([{"id": "DML001", "enabled": False}], [{"id": "DML001", "enabled": True, "severity": "warning"}, {"id": "nope"}])
    assert [(r.id, r.enabled, r.severity) for r in rules] == [("DML001", True, "warning")] and len(notes) == 2
    assert packs.check_pack({"name": "core", "api_version": 1, "engine": ">=0.2.7 <0.3"}) == [] and len(packs.check_pack({"name": "Bad!", "api_version": 2, "engine": ">=9"})) == 3
    assert packs.qualify("x", "A1") == "x:A1" and packs.short_id("x:A1") == "A1" and packs.rules_table(spark).count() == 43
    (tmp_path / "c.toml").write_text('[check]\ndialect = "mysql"\n[[rules]]\nid = "DML001"\nseverity = "error"\n')
    assert packs.load_config(str(tmp_path / "c.toml"))["dialect"] == "mysql"
    a = spark.createDataFrame([("p", b"1"), ("q", b"2")], "path string, content binary")
    b = spark.createDataFrame([("p", b"1"), ("q", b"3"), ("r", b"4")], "path string, content binary")
    assert sorted((r.path, r.problem) for r in packs.verify(packs.lock(a), b).collect()) == [("q", "changed"), ("r", "not locked")]


def test_replay_sinks(spark, tmp_path):
    m = replay.script_statements(parse_scripts(scripts(spark, ("f.sql", "dml", "SELECT 1;\nSELECT 2"))))
    replay.write_manifest(m, str(tmp_path / "m"))
    assert sorted(r.id for r in replay.read_manifest(spark, str(tmp_path / "m")).collect()) == ["f.sql#1", "f.sql#2"]


def test_timings(spark):
    rows = [("a", float(i)) for i in range(1, 201)] + [("b", 1500.0), ("b", 500.0)]
    got = {r.k: r for r in plan_findings.timing_stats(spark.createDataFrame(rows, "k string, ms double"), ["k"]).collect()}
    assert (got["a"].p50_ms, got["a"].p99_ms, got["a"].level) == (100.5, 198.0, "warn") and (got["b"].p99_ms, got["b"].level) == (1500.0, "error")


def test_relations_keep_the_first_direction(spark):
    s = scripts(spark, ("a", "dml", "SELECT c.x FROM customer c JOIN orders o ON c.id = o.customer_id"), ("b", "dml", "SELECT o.x FROM orders o JOIN customer c ON o.customer_id = c.id"))
    e = relations.edges(parse_scripts(s))
    r = relations.relations(e).collect()
    assert [(x.from_table, x.from_column, x.to_table, x.occurrences) for x in r] == [("orders", "customer_id", "customer", 2)] and relations.evidence(e).count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("SELECT * FROM t")
    for again in (1, 2):
        stream = check_stream.watch(spark, str(tmp_path / "in"), [("**/*.sql", "dml", 1)])
        check_stream.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == again
        (tmp_path / "in" / "b.sql").write_text("DELETE FROM t")


def test_text_slice(spark):
    from plumbline.functions.text import line_range, text_slice

    row = spark.createDataFrame([("ab\ncdef\n\ngh",)], "t string")
    one = lambda *a: row.select(text_slice(F.col("t"), *a).alias("x")).first().x
    assert [one(1, 2, 2, 3), one(2, 3, 2, 0), one(2, 2, 2, 4), one(2, 1, 1, 1), one(4, 9, 4, 0), one(3, 1, 9, 2), one(0, 0, 1, 99)] == ["b\ncd", "ef", "de", "", "", "\ngh", "ab"]
    assert row.select(line_range(F.col("t"), 2, 3).alias("x")).first().x == "cdef\n"


@pytest.mark.parametrize("name", ["rollback_names", "rollback_scripts", "rollback_texts", "values_and_sets", "rollback_manifest", "rollback_pairs", "rollback_review", "rollback_sql", "rollback_replace"])
def test_parse_results_are_not_broadcast(spark, sf, name):
    """Their estimated size is far too low, so a broadcast would take a whole corpus through the driver."""
    from plumbline.plans.catalog import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [file_path" in plan and "BroadcastHashJoin [file_path" not in plan


@pytest.mark.parametrize("name", ["values_and_sets", "rollback_manifest", "rollback_pairs", "rollback_review"])
def test_only_totals_are_broadcast(spark, sf, name):
    """In the plan that ran: adaptive execution may still turn a merged join into a broadcast one."""
    from plumbline.plans.catalog import QUERIES

    rows = QUERIES[name](spark, sf)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan()
    assert plan.isFinalPlan()
    joins = [x for x in plan.finalPhysicalPlan().toString().splitlines() if "BroadcastHashJoin" in x or "SortMergeJoin" in x]
    assert joins and all(("BroadcastHashJoin [_range" in x) != ("SortMergeJoin [file_path" in x) for x in joins) and any("SortMergeJoin" in x for x in joins)


def test_running_reads_its_input_once(spark):
    """For rollback, computing it is a parse of the whole corpus; ranging alone would do so twice."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    files = spark.range(1000).selectExpr("concat('f', lpad(id, 4, '0')) file_path", "id % 3 n").mapInPandas(count, "file_path string, n bigint")
    rows = rollback.running(files, ["n"]).orderBy("file_path").collect()
    assert [r.n_before for r in rows] == [sum(i % 3 for i in range(k)) for k in range(1000)]
    assert seen.value == 1000


def test_rollback_texts_number_the_corpus_once(spark, sf, monkeypatch):
    from plumbline.plans.catalog import QUERIES

    runs, running = [], rollback.running
    monkeypatch.setattr(rollback, "running", lambda *a: runs.append(a) or running(*a))
    QUERIES["rollback_texts"](spark, sf)
    assert len(runs) == 1
    asts = parse_scripts(scripts(spark, ("b.sql", "dml", "DELETE FROM t; DROP TABLE u"), ("a.sql", "dml", "TRUNCATE TABLE t"), ("c.sql", "dml", "DELETE FROM v")))
    shared = rollback.numbers(asts)
    for dialect in ("mysql", "gaussdb"):
        o = rollback.Options(dialect=dialect)
        assert rollback.pairs(asts, o, shared).orderBy("seq").collect() == rollback.pairs(asts, o).orderBy("seq").collect()


@pytest.mark.parametrize("name", ["select_accessors", "check_diff", "relation_changed", "replay_changed", "replay_removed"])
def test_joins_with_parse_results_are_merged(spark, name):
    """Nothing that comes out of the parser is the broadcast side of a join. Planned over tables that are too large for other broadcasts."""
    from plumbline.plans.catalog import QUERIES

    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        lines = QUERIES[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    lines = [x for x in lines if x.lstrip(" :")[:2] in ("+-", "- ")]  # others go on with a literal that has line ends
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((k for k in range(at + 1, len(lines)) if depth(lines[k]) <= depth(line)), len(lines))
            assert not any("MapInArrow" in x for x in lines[at:below])


def test_paths_of_a_diff_are_not_broadcast(spark):
    from plumbline.plans.catalog import QUERIES

    plan = QUERIES["check_diff"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [f#" in plan and "BroadcastHashJoin" not in plan


def test_long_texts_are_parsed_a_few_at_a_time():
    import pyarrow as pa
    from pyspark.sql.types import _parse_datatype_string

    from plumbline.operators import parse

    texts = ["SELECT a FROM t WHERE b = '" + "x" * 5000 + f"' -- {k}" for k in range(1000)] + [None, "", "y" * (parse.CHUNK + 1), "SELECT 1"]
    batch = pa.record_batch([pa.array([str(k) for k in range(len(texts))]), pa.array(texts)], ["file_path", "text"])
    out = list(parse._parse_batches("generic", (), _parse_datatype_string(schemas.AST))(iter([batch, batch.slice(0, 0)])))
    assert max(x.num_rows for x in out) <= parse.CHUNK // 5000
    assert [t for x in out for t in x.column("text").to_pylist()] == texts
    assert [len(x["statements"]) for b in out for x in b.column("ast").to_pylist()] == [1] * 1000 + [0, 0, 1, 1]
