"""SQL corpora derived from the driver's tables: one file an order, its text a template chosen by the order key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def templated(spark: SparkSession, sf_dir: str, templates: list[tuple[str, str]], distinct: bool = True) -> DataFrame:
    """scripts (file_path, script_type, text): template number o_orderkey mod n, `{k}` replaced by the key.

    `distinct`: a template without a key ends in it, as a comment, so that no two texts are equal.
    """
    templates = [(kind, x if "{k}" in x or not distinct else x + " -- {k}") for kind, x in templates]
    t = (F.col("o_orderkey") % len(templates) + 1).cast("int")
    kinds, texts = F.array(*[F.lit(k) for k, _ in templates]), F.array(*[F.lit(x) for _, x in templates])
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o/"), key, F.lit(".sql")).alias("file_path"), F.element_at(kinds, t).alias("script_type"), F.replace(F.element_at(texts, t), F.lit("{k}"), key).alias("text"))


MAIN = [
    ("dml", "SELECT * FROM orders WHERE o_orderkey = {k}"),
    ("dml", "SELECT o_orderkey FROM orders WHERE o_orderkey = {k}"),
    ("dml", "DELETE FROM orders"),
    ("dml", "UPDATE orders SET o_totalprice = 0"),
    ("dml", "INSERT INTO orders VALUES ({k})"),
    ("dml", "SELECT o_orderkey FROM orders LIMIT 10"),
    ("dml", "SELECT o_orderkey, c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"),
    ("dml", "SELECT o.o_orderkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"),
    ("dml", "SELECT o_orderkey FROM orders WHERE 1 = 1"),
    ("dml", "SELECT o_orderkey FROM orders WHERE o_custkey = 1 OR o_custkey = 2"),
    ("dml", "SELECT o_orderkey FROM orders UNION SELECT c_custkey FROM customer"),
    ("dml", "SELECT o.o_orderkey FROM orders o, customer c WHERE o.o_custkey = c.c_custkey"),
    ("ddl", "CREATE TABLE t_{k} (id INT)"),
    ("ddl", "DROP TABLE t_{k}"),
    ("dml", "SELECT s.o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey) s"),
    ("dml", "SELEC o_orderkey FROM orders"),
]

#: Statements of several lines: exemptions, comments, transactions, several statements a line.
LINES = [
    ("dml", "-- lint-disable-next-line DML002\nDELETE FROM a{k};\nDELETE FROM b{k};"),
    ("dml", "DELETE FROM a{k}; -- lint-disable-line DML*, DDL001\n/* two\nlines */ UPDATE b SET x = 1; /* lint-disable * */ SELECT * FROM c"),
    ("dml", "SELECT a FROM t{k} WHERE b = NULL;\nSELECT NVL(a, 1) FROM t\nWHERE b <> NULL"),
    ("ddl", "BEGIN;\nCREATE TABLE t{k} (id INT PRIMARY KEY);\nCOMMIT;\nSTART TRANSACTION;\nDROP INDEX i{k}"),
    ("ddl", "CREATE TABLE t{k} (id INT, n VARCHAR(10));\nALTER TABLE t{k} ADD CONSTRAINT pk_t PRIMARY KEY (id);\nCREATE TABLE u{k} (id INT PRIMARY KEY);\nALTER TABLE u{k} DROP PRIMARY KEY"),
    ("ddl", "CREATE TABLE bks_a{k} AS SELECT a FROM b;\n-- NOT_BACKUP\nCREATE TABLE c{k} AS SELECT a FROM b;\n\nCREATE TABLE d{k} AS SELECT a FROM b"),
    ("dml", "SELECT 'unterminated {k}"),
    ("dml", "SELECT a FROM t{k} LIMIT 5; -- RANDOM_ORDER"),
]

#: Names and indexes.
NAMES = [
    ("ddl", "CREATE TABLE users (id INT, dept INT, PRIMARY KEY (id, dept), INDEX ix_a (id), INDEX idx_users_dept (dept), CONSTRAINT uk_x UNIQUE (dept))"),
    ("ddl", "CREATE TABLE t (id INT, CONSTRAINT pk_wrong PRIMARY KEY (id));\nCREATE INDEX idx_t_id ON t (id);\nCREATE UNIQUE INDEX idx_t_a ON t (a, b)"),
    ("ddl", "CREATE INDEX idx_q_a ON q (a);\nCREATE INDEX idx_q_a_b ON q (a, b);\nCREATE INDEX CONCURRENTLY idx_q_c ON q (c)"),
    ("ddl", "CREATE TABLE Users (id INT PRIMARY KEY, \"order\" TEXT)"),
    ("ddl", "CREATE TABLE 2nd (id INT PRIMARY KEY)"),
    ("ddl", "ALTER TABLE a RENAME TO B_new"),
    ("ddl", "CREATE TABLE pg_x (xmin INT PRIMARY KEY, doc CLOB, raw_col VARCHAR(4000))"),
    ("ddl", "CREATE VIEW v AS SELECT a FROM t ORDER BY a DESC NULLS LAST; CREATE MATERIALIZED VIEW mv AS SELECT a FROM t"),
    ("ddl", "ALTER TABLE t ADD COLUMN `a` INT"),
    ("ddl", "CREATE TABLE `quoted` (id INT PRIMARY KEY)"),
]

#: Constructs that the parser recognises.
CONSTRUCTS = [
    ("dml", "SELECT a.x FROM a INNER JOIN b ON a.i = b.i LEFT JOIN c ON a.i = c.i RIGHT OUTER JOIN d USING (i) FULL JOIN e ON a.i = e.i CROSS JOIN f"),
    ("dml", "SELECT a.x FROM a LEFT SEMI JOIN b ON a.i = b.i LEFT ANTI JOIN c ON a.i = c.i NATURAL JOIN d"),
    ("dml", "SELECT x FROM a UNION ALL SELECT x FROM b"),
    ("dml", "SELECT x FROM a INTERSECT SELECT x FROM b"),
    ("dml", "SELECT x FROM a EXCEPT SELECT x FROM b"),
    ("dml", "WITH RECURSIVE c AS (SELECT 1 UNION ALL SELECT 2) SELECT DISTINCT x FROM c ORDER BY x DESC NULLS FIRST OFFSET 5 ROWS FETCH NEXT 3 ROWS ONLY"),
    ("dml", "SELECT sum(v) OVER (PARTITION BY g ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM a QUALIFY x > 1"),
    ("dml", "SELECT g, count(*) FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.i IN (SELECT i FROM c WHERE k = (SELECT max(k) FROM d))) GROUP BY g HAVING count(*) > 1"),
    ("dml", "SELECT CASE WHEN a BETWEEN 1 AND 2 THEN CAST(b AS DECIMAL(10,2)) ELSE NULL END, DATE '2020-01-01', INTERVAL '1' DAY, -c, d IS NULL, f(x) FROM t"),
    ("dml", "SELECT x FROM a WHERE x NOT LIKE 'y%' AND z NOT IN (1, 2)"),
]

#: Joins for relation mining.
JOINS = [
    ("dml", "SELECT o.x FROM orders o JOIN customer c ON o.customer_id = c.id"),
    ("dml", "SELECT c.x FROM customer c LEFT JOIN orders o ON c.id = o.customer_id AND o.kind = 1"),
    ("dml", "SELECT a.x FROM lineitem a, part b WHERE lineitem.part_id = part.id AND a.q > 1"),
    ("dml", "SELECT e.x FROM emp e JOIN emp m ON e.boss_id = m.id OR e.x = m.x"),
    ("dml", "SELECT n.x FROM nation n JOIN region r ON n.region_id = r.region_id"),
    ("dml", "SELECT x FROM t WHERE i IN (SELECT a.i FROM a JOIN b ON a.i = b.i)"),
]

#: Texts put together from parts: of each list the element that the key's next digit (in mixed base) names.
READS = [
    ["SELECT *", "SELECT a{k}", "SELECT a, b{k}"], [" FROM t{k}", " FROM (SELECT a, b FROM s{k})", " FROM t{k} x INNER JOIN u y ON x.i = y.i"],
    ["", " WHERE 1 = 1", " WHERE a = {k}", " WHERE a = 1 OR b = {k}", " WHERE a = NULL"], ["", " LIMIT 5", " ORDER BY a ASC NULLS LAST LIMIT 5"], [" -- {k}"],
]
CHANGES = [
    ["UPDATE t{k} SET a = 1", "DELETE FROM t{k}"], ["", " WHERE 'x' = 'x'", " WHERE a = {k}", " WHERE a = 1 OR b = {k}", " WHERE a IN (SELECT b FROM u{k})"], ["", " ORDER BY a ASC NULLS LAST", " GROUP BY a"],
]
SHAPES = [
    ["", "WITH c{k} AS (SELECT 1) ", "WITH t0 AS (SELECT 1) "], ["SELECT t0.x FROM " + ", ".join(f"t{i}" for i in range(n + 1)) for n in range(9)], ["", " INNER JOIN z"],
    ["", " WHERE CASE WHEN t0.a THEN 1 END = {k}", " WHERE CASE WHEN t0.a THEN CASE WHEN t0.b THEN 1 END END = {k}"], [" -- {k}"],
]
TABLES = [
    ["CREATE TABLE t{x} (id INT PRIMARY KEY)", 'CREATE TABLE "a-{k}" (id INT PRIMARY KEY)', "CREATE TABLE t{k} (id INT PRIMARY KEY{c})", "CREATE TABLE order_{k} (id INT PRIMARY KEY)"],
]


def composed(spark: SparkSession, sf_dir: str, parts: list[list[str]], script_type: str = "dml") -> DataFrame:
    """scripts of which each text is put together from parts. `{x}`: 55 + key mod 13 letters; `{c}`: key mod 14 text columns."""
    k, text, base = F.col("o_orderkey"), F.lit(""), 1
    for options in parts:
        digit = (F.floor(k / base) % len(options) + 1).cast("int")
        text, base = F.concat(text, F.element_at(F.array(*[F.lit(x) for x in options]), digit)), base * len(options)
    columns = F.array_join(F.transform(F.sequence(F.lit(0), (k % 14).cast("int")), lambda i: F.when(i > 0, F.concat(F.lit(", c"), i.cast("string"), F.lit(" TEXT"))).otherwise("")), "")
    key = k.cast("string")
    for name, value in (("{k}", key), ("{x}", F.repeat(F.lit("x"), (k % 13 + 55).cast("int"))), ("{c}", columns)):
        text = F.replace(text, F.lit(name), value)
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o/"), key, F.lit(".sql")).alias("file_path"), F.lit(script_type).alias("script_type"), text.alias("text"))


#: Statements on which dialects differ.
DIALECTS = [
    "SELECT a FROM t{k} MINUS SELECT a FROM u", "SELECT e FROM emp{k} CONNECT BY PRIOR e = m START WITH e = 1", "SELECT `a` FROM `t{k}`", "SELECT a FROM t LIMIT {k}, 2", "SELECT {k} +",
    'SELECT "x{k}" FROM a INNER JOIN b ON a.i = b.i', "SELECT a FROM t WHERE t.x = {k} AND t.y(+) = 1",
]

#: Mappers that do not parse, one for each category, and one that does.
BROKEN = [
    '<select id="s">SELECT \'x FROM t{k}</select>', '<select id="s"> </select>', '<select id="s">SELECT <include refid="none{k}"/> FROM WHERE</select>', '<select id="s">SELECT ${{a}} ${{b}} ${{c}} FROM</select>',
    '<select id="s">{{call p{k}()}}</select>', '<select id="s">SELEC {k}</select>', '<select id="s">SELECT a FROM t{k}</select>',
]


def broken_mappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    texts = F.array(*[F.lit(x.replace("{{", "{").replace("}}", "}")) for x in BROKEN])
    body = F.replace(F.element_at(texts, (k % len(BROKEN) + 1).cast("int")), F.lit("{k}"), k.cast("string"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("m/"), k, F.lit(".xml")).alias("file_path"), F.concat(F.lit('<mapper namespace="m">'), body, F.lit("</mapper>")).alias("text"))


def including_mappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapper for each order that includes a fragment of one of 50 other files; those include a fragment of one more. The statement
    is key mod 5 lines below the top, and deletes without WHERE for every second key."""
    k = F.col("o_orderkey")
    s, g = k.cast("string"), (k % 50).cast("string")
    query = F.concat(F.lit('<select id="q">SELECT <include refid="shared'), g, F.lit('.cols"/> FROM t WHERE id = '), s, F.lit("</select>"))
    text = F.concat(F.lit('<mapper namespace="m'), s, F.lit('">'), F.repeat(F.lit("\n"), (k % 5).cast("int")), F.when(k % 2 == 0, F.concat(F.lit('<delete id="d">DELETE FROM u'), s, F.lit("</delete>"))).otherwise(query), F.lit("</mapper>"))
    own = table(spark, sf_dir, "orders").select(F.concat(F.lit("m/"), s, F.lit(".xml")).alias("file_path"), text.alias("text"))
    n = F.col("id").cast("string")
    shared = spark.range(50).select(F.concat(F.lit("s/"), n, F.lit(".xml")).alias("file_path"), F.concat(F.lit('<mapper namespace="shared'), n, F.lit('"><sql id="cols">c'), n, F.lit(', <include refid="base.more"/></sql></mapper>')).alias("text"))
    base = spark.range(1).select(F.lit("s/base.xml").alias("file_path"), F.lit('<mapper namespace="base"><sql id="more">d, e</sql></mapper>').alias("text"))
    return own.unionByName(shared).unionByName(base)


MAPPER = [
    '<mapper namespace="m{k}"><sql id="cols">id, name</sql><select id="all">SELECT <include refid="cols"/> FROM users</select></mapper>',
    '<mapper namespace="m{k}">\n<select id="find">SELECT id FROM users\n<where><if test="a">AND a = #{{a}}</if><if test="b">AND b = #{{b}}</if></where></select></mapper>',
    '<mapper namespace="m{k}"><update id="up">UPDATE users <set><if test="n">name = #{{n}},</if></set> WHERE id = #{{id}}</update></mapper>',
    '<mapper namespace="m{k}"><select id="in">SELECT id FROM users WHERE id IN <foreach collection="ids" open="(" separator="," close=")" item="i">#{{i}}</foreach></select></mapper>',
    '<mapper namespace="m{k}"><select id="ch">SELECT id FROM users <choose><when test="a">WHERE a = 1</when><when test="b">WHERE b = 2</when><otherwise>WHERE c = 3</otherwise></choose></select></mapper>',
    '<mapper namespace="m{k}"><delete id="d">DELETE FROM ${{tbl}}</delete><select id="x">SELECT <include refid="none"/> 1</select></mapper>',
]


def mappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML mapper files (file_path, text)."""
    texts = F.array(*[F.lit(x.replace("{{", "{").replace("}}", "}")) for x in MAPPER])
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("m/"), key, F.lit(".xml")).alias("file_path"), F.replace(F.element_at(texts, (F.col("o_orderkey") % len(MAPPER) + 1).cast("int")), F.lit("{k}"), key).alias("text"))
