"""The results of `plumbline.plans.catalog` in plain SQL (DuckDB), written from the meaning of each operator.

Where a corpus is a set of templates, expected facts are listed by template number, independently of the parser.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_NULL = "NULL"


def _v(x) -> str:
    if x is None:
        return _NULL
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def _facts(n: int, columns: list[str], rows: list[tuple], types: dict[str, str] | None = None, path: str = "'o/' || o_orderkey || '.sql'", lead: str = "file_path", extra: str = "") -> str:
    """Rows (template, values...) joined to orders by template; `{k}` in a text is the key."""
    types = types or {}
    out = []
    for c in columns:
        kind = types.get(c)
        out.append(f"CAST(f.{c} AS {kind}) AS {c}" if kind else f"replace(f.{c}, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS {c}")
    values = ", ".join("(" + ", ".join(_v(x) for x in r) + ")" for r in rows)
    head = f"{path} AS {lead}, " if lead else ""
    return f"SELECT {head}{', '.join(out)} FROM orders JOIN (VALUES {values}) f(t, {', '.join(columns)}) ON o_orderkey % {n} = f.t {extra}"


_HIT = {"line": "BIGINT", "end_line": "BIGINT"}
_MAIN = [
    (0, "DML001", "error", 1, 1), (2, "DML002", "error", 1, 1), (3, "DML002", "error", 1, 1), (4, "DML003", "error", 1, 1), (5, "DML007", "error", 1, 1), (6, "DML005", "warning", 1, 1), (6, "DML101", "warning", 1, 1),
    (6, "DML109", "warning", 1, 1), (7, "DML101", "warning", 1, 1), (8, "DML108", "warning", 1, 1), (9, "DML111", "warning", 1, 1), (10, "DML106", "warning", 1, 1), (12, "DDL002", "warning", 1, 1), (13, "DDL001", "error", 1, 1),
    (14, "DML105", "warning", 1, 1), (14, "gaussdb:GDML005", "error", 1, 1), (14, "gaussdb:GDML005", "error", 1, 1), (15, "PARSE", "warning", 1, 1),
]
ORACLES["violations"] = ORACLES["violations_repeated"] = _facts(16, ["rule_id", "severity", "line", "end_line"], _MAIN, _HIT)

_OR = "OR usually prevents efficient index utilization; prefer IN (...) for same-column values, UNION ALL for cross-column disjunctions, or splitting the query."
_DEFAULT = [
    (0, "dml", "DML001", "no_select_all", "dml-safety", "SELECT * is not allowed. Specify columns explicitly.", 1, 1),
    (2, "dml", "DML002", "no_delete_update_without_where", "dml-safety", "DELETE without WHERE clause will remove all rows from table: orders. Add a WHERE condition or use TRUNCATE if intentional.", 1, 1),
    (3, "dml", "DML002", "no_delete_update_without_where", "dml-safety", "UPDATE without WHERE clause will modify all rows in table: orders. Add a WHERE condition.", 1, 1),
    (4, "dml", "DML003", "insert_columns_required", "dml-safety", "INSERT must specify target columns explicitly: INSERT INTO orders (col1, col2, ...) VALUES (...)", 1, 1),
    (5, "dml", "DML007", "order_by_required_for_pagination", "dml-safety", "Pagination query (LIMIT/OFFSET/FETCH) without ORDER BY produces non-deterministic results. Add an ORDER BY clause, or if random ordering is intentional, add '-- RANDOM_ORDER' comment to suppress.", 1, 1),
    (6, "dml", "DML005", "column_references_qualified", "dml-style", "Column reference should be qualified with table name in multi-table query. Use table.column syntax.", 1, 1),
    (6, "dml", "DML109", "join_type_required", "dml-style", "JOIN must specify an explicit join type (e.g. LEFT JOIN or INNER JOIN); bare JOIN is not allowed.", 1, None),
    (8, "dml", "DML108", "no_constant_where", "dml-safety", "Constant/tautology condition in WHERE clause ('1 = 1'). This always matches or never matches and is usually dead code or a dynamic-SQL placeholder. Remove it or replace with a real condition.", 1, 1),
    (9, "dml", "DML111", "no_or_in_where", "dml-performance", f"WHERE clause combines conditions with OR ('o_custkey = 1 OR o_custkey = 2'). {_OR} See docs/sql-guidelines/avoid-or-in-where.md.", 1, 1),
    (12, "ddl", "DDL002", "primary_key_required", "ddl-safety", "CREATE TABLE t_{k} must include a PRIMARY KEY (column constraint, table constraint, or ALTER TABLE ... ADD PRIMARY KEY)", 1, 1),
    (13, "ddl", "DDL001", "no_drop_table", "ddl-safety", "DROP TABLE is not allowed in DDL scripts, use a dedicated migration instead: t_{k}", 1, 1),
    (15, "dml", "PARSE", "parse_error", "engine", "SQL parse error with generic dialect at line 1 (statement skipped)", 1, None),
]
_D = ["script_type", "rule_id", "rule_name", "rule_group", "message", "line", "col"]
ORACLES["violations_default"] = _facts(16, _D, _DEFAULT, {"line": "BIGINT", "col": "BIGINT"})
_SEV = {"DDL001": "error", "DDL002": "warning", "DML002": "error", "DML001": "error", "DML003": "error", "DML005": "warning", "DML007": "error", "DML108": "warning", "DML109": "warning", "DML111": "warning", "PARSE": "warning"}

_LINES = [
    (0, "DML002", "error", 3, 3), (1, "DML002", "error", 3, 3), (2, "DML103", "error", 1, 1), (2, "DML103", "error", 3, 3), (2, "DML104", "warning", 1, 1), (3, "gaussdb:GDDL001", "error", 4, 4),
    (4, "DDL002", "warning", 3, 3), (5, "DDL004", "warning", 5, 5), *[(5, "DDL002", "warning", n, n) for n in (1, 3, 5)], (6, "PARSE", "warning", 1, None), (6, "DML001", "error", 1, None), (6, "DML002", "error", 1, None), (6, "DML007", "error", 1, None),
]
# template 1: line 3 carries `lint-disable *`, so its UPDATE and SELECT * are exempt as well
_LINES = [r for r in _LINES if r[0] != 1]
ORACLES["violations_lines"] = _facts(8, ["rule_id", "severity", "line", "end_line"], _LINES, _HIT)

_TN = "table names must contain only lowercase letters, digits, and underscores, and must not start with a digit"
_NAMES = [
    (0, "DDL005", "Non-unique index 'ix_a' on table 'users' should be named 'idx_users_id' (idx_table_field_field)", 1),
    (0, "DDL005", "Unique constraint 'uk_x' on table 'users' should be named 'uk_users_dept' (uk_table_field_field)", 1),
    (0, "DDL006", "Index 'ix_a' on table 'users' is redundant: its columns are a leftmost prefix of the primary key (id, dept), already covered by PK", 1),
    (1, "DDL005", "Primary key constraint 'pk_wrong' on table 't' should be named 'pk_t' (pk_table)", 1),
    (1, "DDL005", "Index 'idx_t_a' on table 't' should be named 'uk_t_a_b' (uk_table_field_field)", 3),
    (1, "DDL006", "Index 'idx_t_id' on table 't' is redundant: its columns exactly match the primary key columns (id)", 2),
    (1, "gaussdb:GIDX001", "CREATE INDEX 'idx_t_id' on 't' must use CONCURRENTLY when the system has online transactions", 2),
    (1, "gaussdb:GIDX001", "CREATE INDEX 'idx_t_a' on 't' must use CONCURRENTLY when the system has online transactions", 3),
    (2, "DDL006", "Index 'idx_q_a' on table 'q' is redundant: its columns (a) are a leftmost prefix of index 'idx_q_a_b' (a, b)", 1),
    (2, "gaussdb:GIDX001", "CREATE INDEX 'idx_q_a' on 'q' must use CONCURRENTLY when the system has online transactions", 1),
    (2, "gaussdb:GIDX001", "CREATE INDEX 'idx_q_a_b' on 'q' must use CONCURRENTLY when the system has online transactions", 2),
    (3, "DDL003", "Column name '\"order\"' in table 'Users' uses a SQL reserved keyword", 1),
    (3, "DDL007", "Table name 'Users' contains invalid character 'U' (only lowercase letters, digits, and underscores are allowed); " + _TN, 1),
    (3, "gaussdb:GNAM002", "column name '\"order\"' must not be defined with quotes", 1),
    (4, "PARSE", "SQL parse error with generic dialect at line 1 (statement skipped)", 1),
    (5, "DDL007", "Renamed table name 'B_new' contains invalid character 'B' (only lowercase letters, digits, and underscores are allowed); " + _TN, 1),
    (6, "gaussdb:GNAM003", "object name 'pg_x' uses a system-reserved prefix (pg_/gs_/adm_/my_/db_)", 1),
    (6, "gaussdb:GTYP002", "column 'xmin' of table 'pg_x' uses a reserved system column name", 1),
    (6, "gaussdb:GTYP003", "column 'doc' uses non-recommended type 'CLOB'; prefer a GaussDB recommended basic type", 1),
    (7, "gaussdb:GOBJ001", "materialized view 'mv' is not allowed; use a regular table or view instead", 1),
    (7, "gaussdb:GOBJ002", "view 'v' must not contain ORDER BY; let the caller sort instead", 1),
    (7, "gaussdb:GOBJ003", "view 'v' is discouraged; prefer querying base tables (and avoid nested views)", 1),
    (8, "gaussdb:GDCL001", "DDL must not quote column names (found quote or backtick in statement text)", 1),
    (9, "gaussdb:GNAM002", "object name '`quoted`' must not be defined with quotes", 1),
]
ORACLES["violations_names"] = _facts(10, ["rule_id", "message", "line"], _NAMES, {"line": "BIGINT"})
ORACLES["rule_filter"] = _facts(16, ["rule_id"], [(6, "DML101"), (6, "DML109"), (7, "DML101"), (8, "DML108"), (14, "DML105"), (15, "PARSE")])

_KINDS = [
    (0, 0, "DELETE", 2, 2, 1), (0, 1, "DELETE", 3, 3, 1), (1, 0, "DELETE", 1, 1, 1), (1, 1, "UPDATE", 3, 3, 10), (1, 2, "SELECT", 3, 3, 51), (2, 0, "SELECT", 1, 1, 1), (2, 1, "SELECT", 2, 3, 1),
    (3, 0, "START_TRANSACTION", 1, 1, 1), (3, 1, "CREATE_TABLE", 2, 2, 1), (3, 2, "COMMIT", 3, 3, 1), (3, 3, "START_TRANSACTION", 4, 4, 1), (3, 4, "DROP_INDEX", 5, 5, 1), (4, 0, "CREATE_TABLE", 1, 1, 1), (4, 1, "ALTER_TABLE", 2, 2, 1),
    (4, 2, "CREATE_TABLE", 3, 3, 1), (4, 3, "ALTER_TABLE", 4, 4, 1), (5, 0, "CREATE_TABLE", 1, 1, 1), (5, 1, "CREATE_TABLE", 3, 3, 1), (5, 2, "CREATE_TABLE", 5, 5, 1), (7, 0, "SELECT", 1, 1, 1),
]
_KT = {"stmt_index": "BIGINT", "line": "BIGINT", "end_line": "BIGINT", "col": "BIGINT"}
ORACLES["statement_kinds"] = _facts(8, ["stmt_index", "kind", "line", "end_line", "col"], _KINDS, _KT)

_F = ["select_id", "depth", "multiplicity", "table_count", "has_wildcard", "is_distinct", "is_union", "is_union_all", "is_intersect", "is_except", "has_limit", "has_offset", "has_fetch", "has_order_by", "has_group_by", "joins", "kinds", "where_kind", "ctes", "windows"]
_FT = dict.fromkeys(("select_id", "depth", "table_count"), "INTEGER") | {"multiplicity": "BIGINT"} | dict.fromkeys(_F[4:15], "BOOLEAN")


def _sel(t, sid=0, depth=0, tables=1, joins="", kinds="IDENTIFIER", where=None, ctes="", windows="", **flags):
    return (t, sid, depth, 1 << max(0, depth - 1), tables, *[flags.get(f, False) for f in _F[4:15]], joins, kinds, where, ctes, windows)


_CI = "COMPOUND_IDENTIFIER"
_SELECTS = [
    _sel(0, tables=6, joins="INNER:on,LEFT:on,RIGHT:on,FULL:on,CROSS:on", kinds=_CI), _sel(1, tables=4, joins="LEFT_SEMI:on,LEFT_ANTI:on,INNER:on", kinds=_CI), _sel(2, tables=0, kinds="", is_union=True, is_union_all=True),
    _sel(3, tables=0, kinds="", is_intersect=True), _sel(4, tables=0, kinds="", is_except=True), _sel(5, ctes="c", is_distinct=True, has_limit=True, has_offset=True, has_fetch=True, has_order_by=True),
    _sel(5, 1, 1, tables=0, kinds="", is_union=True, is_union_all=True), _sel(6, kinds="FUNCTION", windows="sum"), _sel(7, kinds="IDENTIFIER,FUNCTION", where="EXISTS", has_group_by=True), _sel(7, 1, 1, kinds="LITERAL", where="IN_SUBQUERY"),
    _sel(7, 2, 2, where="BINARY_OP"), _sel(7, 3, 3, kinds="FUNCTION"), _sel(8, kinds="CASE,TYPED_STRING,INTERVAL,UNARY_OP,IS_NULL,FUNCTION"), _sel(9, where="BINARY_OP"),
]
ORACLES["select_facts"] = _facts(10, _F, _SELECTS, _FT)
_TEXT = [(k, w, h) for k, w, h in [(0, None, None), (1, None, None), (2, None, None), (3, None, None), (4, None, None), (5, None, None), (6, None, None), (7, "EXISTS (SELECT 1 FROM b WHERE b.i IN(SELECT i FROM c WHERE k =(SELECT max(k) FROM d)))", "count(*) > 1"), (8, None, None), (9, "x NOT LIKE 'y%' AND z NOT IN (1, 2)", None)]]
ORACLES["canonical_text"] = _facts(10, ["where_clause", "having_text"], _TEXT)
ORACLES["comment_list"] = _facts(8, ["comment_text", "line", "kind"], [(0, "lint-disable-next-line DML002", 1, "LINE"), (1, "lint-disable-line DML*, DDL001", 1, "LINE"), (1, "two\nlines", 2, "BLOCK"), (1, "lint-disable *", 3, "BLOCK"), (5, "NOT_BACKUP", 2, "LINE"), (7, "RANDOM_ORDER", 1, "LINE")], {"line": "BIGINT"})
_KIND16 = ["SELECT", "SELECT", "DELETE", "UPDATE", "INSERT", "SELECT", "SELECT", "SELECT", "SELECT", "SELECT", "SELECT", "SELECT", "CREATE_TABLE", "DROP_TABLE", "SELECT", "PARSE_ERROR"]
ORACLES["explain_json"] = _facts(16, ["kind"], list(enumerate(_KIND16)))
ORACLES["ast_aggregates"] = _facts(
    8, ["kinds", "has_create_table", "has_drop_table"],
    [(0, "DELETE", False, False), (1, "DELETE,SELECT,UPDATE", False, False), (2, "SELECT", False, False), (3, "COMMIT,CREATE_TABLE,DROP_INDEX,START_TRANSACTION", True, False), (4, "ALTER_TABLE,CREATE_TABLE", True, False), (5, "CREATE_TABLE", True, False), (7, "SELECT", False, False)],
    {"has_create_table": "BOOLEAN", "has_drop_table": "BOOLEAN"},
)
ORACLES["statement_at_line"] = _facts(8, ["kind", "line"], [(0, "DELETE", 2), (1, None, None), (2, "SELECT", 2), (3, "CREATE_TABLE", 2), (4, "ALTER_TABLE", 2), (5, None, None), (6, None, None), (7, None, None)], {"line": "BIGINT"})

ORACLES["line_range_text"] = "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS lines FROM documents"
ORACLES["text_slices"] = """
SELECT doc_id, substring(l[1], 5) || CASE WHEN len(l) > 1 THEN chr(10) || l[2] ELSE '' END || CASE WHEN len(l) > 2 THEN chr(10) || substring(l[3], 1, 8) ELSE '' END AS part
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
"""
ORACLES["line_endings"] = """
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN replace(text, chr(10), chr(13))
             WHEN 2 THEN 'a' || chr(13) || chr(10) || 'b' || chr(13) || 'c' || chr(10) || text ELSE text END AS x FROM documents),
c AS (SELECT *, (length(x) - length(replace(x, chr(13) || chr(10), chr(10)))) AS crlf, length(x) - length(replace(x, chr(13), '')) AS cr_all FROM t),
d AS (SELECT *, cr_all - crlf AS cr, 1 + length(regexp_replace(string_split(x, chr(13))[1], '[^\\n]', '', 'g')) AS first FROM c WHERE cr_all > 0)
SELECT CAST(doc_id AS VARCHAR) AS file_path, 'FILE002' AS rule_id, 'warning' AS severity,
  'Line endings should be LF (\\n), but ' || CASE WHEN crlf > 0 AND cr > 0 THEN 'mixed CRLF (' || crlf || ') and lone CR (' || cr || ') line endings' WHEN crlf > 0 THEN 'CRLF line endings (' || crlf || ' line(s))' ELSE 'lone CR line endings (' || cr || ' line(s))' END
  || ' were found; first at line ' || first || '. Convert line endings to LF.' AS message, CAST(first AS BIGINT) AS line FROM d
"""
ORACLES["encodings"] = """
SELECT CAST(doc_id AS VARCHAR) AS file_path, 'FILE001' AS rule_id, CASE doc_id % 7
  WHEN 0 THEN 'File must be UTF-8 without BOM, but a UTF-8 BOM (EF BB BF) was found at the start of the file. Remove the BOM.'
  WHEN 1 THEN 'File must be UTF-8 without BOM, but a UTF-32 LE BOM was found. Re-encode the file as UTF-8.' WHEN 2 THEN 'File must be UTF-8 without BOM, but a UTF-32 BE BOM was found. Re-encode the file as UTF-8.'
  WHEN 3 THEN 'File must be UTF-8 without BOM, but a UTF-16 LE BOM was found. Re-encode the file as UTF-8.' WHEN 4 THEN 'File must be UTF-8 without BOM, but a UTF-16 BE BOM was found. Re-encode the file as UTF-8.'
  ELSE 'File is not valid UTF-8: invalid byte sequence at offset 2. Re-encode the file as UTF-8 (no BOM).' END AS message, CAST(1 AS BIGINT) AS line FROM documents WHERE doc_id % 7 < 6
"""
ORACLES["classification"] = "SELECT doc_id, CASE WHEN source = 'src1' THEN 'ddl' WHEN doc_id % 10 = 7 THEN 'mixed' WHEN lang = 'en' THEN 'dml' ELSE 'sql' END AS script_type FROM documents"
ORACLES["directories"] = """
WITH have AS (SELECT DISTINCT lang || '/' || source AS path FROM documents UNION SELECT DISTINCT lang FROM documents), need AS (SELECT 'en/src' || n_nationkey AS path FROM nation)
SELECT path, 'missing' AS issue_type FROM need WHERE path NOT IN (SELECT path FROM have)
UNION ALL SELECT path, 'unexpected' FROM have WHERE path NOT IN (SELECT path FROM need) AND path <> 'en' AND NOT (path LIKE 'de/%' OR path = 'de') AND path <> 'fr/src1'
"""
_MPATH = "'m/' || o_orderkey || '.xml'"
_MT = [(0, "m{k}.all", "dml", 0), (1, "m{k}.find", "dml", 1), (2, "m{k}.up", "dml", 0), (3, "m{k}.in", "dml", 0), (4, "m{k}.ch", "dml", 0), (5, "m{k}.d", "cleanup", 0), (5, "m{k}.x", "dml", 0)]
ORACLES["statement_type_map"] = _facts(6, ["statement_id", "script_type", "line_offset"], _MT, {"line_offset": "BIGINT"}, _MPATH)
_RES = "'ORDER'"
ORACLES["identifiers"] = """
WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 's."' || p_brand || '"' WHEN 1 THEN '`order`' WHEN 2 THEN 'pg_' || p_partkey WHEN 3 THEN p_name WHEN 4 THEN 'schema.Table' ELSE 'col_' || p_size END AS name FROM part),
l AS (SELECT *, regexp_replace(trim(string_split(name, '.')[-1]), '^["`]|["`]$', '', 'g') AS leaf FROM n)
SELECT p_partkey, regexp_replace(trim(name), '^["`]|["`]$', '', 'g') AS strip_quotes, leaf AS ident_leaf, lower(leaf) AS normalize_ident, regexp_full_match(trim(name), '[A-Za-z_][A-Za-z0-9_]*') AS is_valid_ident,
  (regexp_full_match(trim(name), '".*"') OR regexp_full_match(trim(name), '`.*`')) AS is_quoted_ident, upper(leaf) IN ('ORDER', 'TABLE') AS is_reserved_word, (lower(leaf) LIKE 'pg\\_%' ESCAPE '\\') AS has_reserved_prefix, CAST(strlen(name) AS INTEGER) AS len_bytes FROM l
"""
ORACLES["placeholder_text"] = "SELECT c_custkey, 'SELECT _var_a_b FROM _var WHERE x = ? AND k = ' || c_custkey || ' #{open' AS sql FROM customer"
ORACLES["repaired_text"] = "SELECT c_custkey, 'UPDATE t SET  a = ''(,''  WHERE x IN ( 1, 2 ) AND k = ' || c_custkey AS sql FROM customer"
ORACLES["rewritten_text"] = """SELECT s_suppkey, 'SELECT COALESCE(a, CURRENT_TIMESTAMP) FROM (SELECT 1) AS dual EXCEPT SELECT "b`c", ''NVL('' FROM t -- MINUS SELECT' || chr(10) || '; ALTER TABLE t ADD COLUMN x INT, ADD COLUMN y DECIMAL(3,1); ALTER TABLE t ADD CONSTRAINT c PRIMARY KEY (i' || s_suppkey || ') USING INDEX i' || s_suppkey AS sql FROM supplier"""
ORACLES["top_level_words"] = "SELECT s_suppkey, 'UPDATE T SET A WHERE K GROUP BY X' AS words FROM supplier"
ORACLES["comma_joins"] = "SELECT 'o/' || o_orderkey || '.sql' AS file_path, o_orderkey % 16 = 11 AS has_comma_join FROM orders"
ORACLES["placeholder_probe"] = "SELECT c_custkey, CAST(1 + c_custkey % 5 + 1 AS INTEGER) AS placeholders, CAST(c_custkey % 5 + 1 AS INTEGER) AS in_params, c_custkey % 2 = 0 AS ctas FROM customer"
ORACLES["values_and_sets"] = """
SELECT 'o/' || o_orderkey || '.sql' AS file_path, CASE o_orderkey % 2 WHEN 0 THEN 'DELETE FROM `t` WHERE `id` = ' || o_orderkey || ';' || chr(10) || 'DELETE FROM `t` WHERE `id` = 2;'
  ELSE 'UPDATE `t` JOIN `bks_t_20240101_' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || '` ON `t`.`id` = `bks_t_20240101_' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || '`.`id`' || chr(10) || 'SET `t`.`a` = `bks_t_20240101_' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || '`.`a`, `t`.`b` = `bks_t_20240101_' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || '`.`b`;' END AS rollback,
  true AS reliable, CASE o_orderkey % 2 WHEN 0 THEN 'none' ELSE 'optional' END AS review_level
FROM (SELECT o_orderkey, sum(o_orderkey % 2) OVER (ORDER BY 'o/' || o_orderkey || '.sql') AS n FROM orders)
"""
ORACLES["hunk_violations"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS file_path, l_linenumber AS rule_id, CAST(l_linenumber * 10 AS BIGINT) AS line FROM lineitem
WHERE l_orderkey % 3 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) AND (l_orderkey % 7 = 0 OR (l_linenumber * 10 <= l_orderkey % 60 + 4 AND l_linenumber * 10 + 5 >= l_orderkey % 60))
"""
ORACLES["diff_hunks"] = """
SELECT o_orderkey || '.sql' AS path, side, CAST(s AS BIGINT) AS start_line, CAST(s + n - 1 AS BIGINT) AS end_line, o_orderkey % 3 = 0 AS is_new FROM (
  SELECT o_orderkey, 'old' AS side, o_orderkey % 50 AS s, 1 AS n FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, 'new', o_orderkey % 40, 3 FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, 'new', 1, 4 FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'old', 90, 2 FROM orders WHERE o_orderkey % 2 = 0)
"""
_MS = [
    (0, "m{k}.all", "select", 1, "SELECT id, name FROM users", "SELECT id, name FROM users", False, False, 0, 1),
    (1, "m{k}.find", "select", 2, "SELECT id FROM users WHERE a = ? AND b = ?", "SELECT id FROM users WHERE a = ?", True, False, 2, 4),
    (2, "m{k}.up", "update", 1, "UPDATE users SET name = ? WHERE id = ?", "UPDATE users SET name = ? WHERE id = ?", True, False, 1, 2),
    (3, "m{k}.in", "select", 1, "SELECT id FROM users WHERE id IN (?)", "SELECT id FROM users WHERE id IN (?)", True, False, 0, 3),
    (4, "m{k}.ch", "select", 1, "SELECT id FROM users WHERE a = 1", "SELECT id FROM users WHERE a = 1", True, False, 0, 3),
    (5, "m{k}.d", "delete", 1, "DELETE FROM _var_tbl", "DELETE FROM _var_tbl", False, True, 0, 1),
    (5, "m{k}.x", "select", 1, "SELECT /* missing include: none */ 1", "SELECT /* missing include: none */ 1", False, False, 0, 1),
]
ORACLES["mapper_statements"] = _facts(6, ["statement_id", "statement_type", "raw_xml_line", "sql_all", "sql_first", "has_dynamic", "has_dollar", "n_ifs", "n_variants"], _MS, {"raw_xml_line": "BIGINT", "has_dynamic": "BOOLEAN", "has_dollar": "BOOLEAN", "n_ifs": "INTEGER", "n_variants": "INTEGER"}, _MPATH)
_U = "SELECT id FROM users"
_MV = [
    (0, "m{k}.all", 0, "SELECT id, name FROM users"), (1, "m{k}.find", 0, _U + " WHERE a = ? AND b = ?"), (1, "m{k}.find", 1, _U + " WHERE a = ?"), (1, "m{k}.find", 2, _U + " WHERE b = ?"), (1, "m{k}.find", 3, _U),
    (2, "m{k}.up", 0, "UPDATE users SET name = ? WHERE id = ?"), (2, "m{k}.up", 1, "UPDATE users WHERE id = ?"), (3, "m{k}.in", 0, _U + " WHERE id IN (?)"), (3, "m{k}.in", 1, _U + " WHERE id IN"), (3, "m{k}.in", 2, _U + " WHERE id IN (?,?,?)"),
    (4, "m{k}.ch", 0, _U + " WHERE a = 1"), (4, "m{k}.ch", 1, _U + " WHERE b = 2"), (4, "m{k}.ch", 2, _U + " WHERE c = 3"), (5, "m{k}.d", 0, "DELETE FROM _var_tbl"), (5, "m{k}.x", 0, "SELECT /* missing include: none */ 1"),
]
ORACLES["mapper_variants"] = _facts(6, ["statement_id", "k", "sql"], _MV, {"k": "INTEGER"}, lead="")
ORACLES["mapper_violations"] = _facts(6, ["rule_id", "line"], [(5, "DML002", 1)], {"line": "BIGINT"}, _MPATH)
ORACLES["mapper_failures"] = """
WITH b AS (SELECT 'm/' || o_orderkey || '.xml#m.s' AS id, CASE o_orderkey % 7 WHEN 0 THEN 'tokenize' WHEN 1 THEN 'empty' WHEN 2 THEN 'missing include' WHEN 3 THEN 'dynamic substitution' WHEN 4 THEN 'procedure call' ELSE 'syntax' END AS category
  FROM orders WHERE o_orderkey % 7 < 6)
SELECT category, count(*) AS n, array_to_string(list_slice(list_sort(list(id)), 1, 3), ', ') AS examples FROM b GROUP BY category
"""
_PARTS = lambda *sizes: ", ".join(f"(o_orderkey // {base}) % {n} AS {name}" for name, n, base in _digits(sizes))


def _digits(sizes):
    base = 1
    for name, n in sizes:
        yield name, n, base
        base *= n


def _fires(parts: str, rules: list[tuple[str, str]], extra: str = "", columns: str = "") -> str:
    """A row for each order and rule whose condition on the order's parts holds."""
    each = " UNION ALL ".join(f"SELECT k, '{r}' AS rule_id{extra} FROM g WHERE {c}" for r, c in rules)
    return f"WITH g AS (SELECT o_orderkey AS k, {parts} FROM orders) SELECT 'o/' || k || '.sql' AS file_path, rule_id, CAST(1 AS BIGINT) AS line{columns} FROM ({each})"


ORACLES["rules_on_reads"] = _fires(
    _PARTS(("p", 3), ("f", 3), ("w", 5), ("l", 3)),
    [("DML001", "p = 0"), ("DML004", "f = 1"), ("DML005", "f = 2 AND p > 0"), ("DML101", "f = 2 AND p > 0"), ("DML108", "w = 1"), ("DML111", "w = 3"), ("DML103", "w = 4"), ("DML007", "l = 1")],
)
ORACLES["rules_on_changes"] = _fires(
    _PARTS(("v", 2), ("w", 5), ("t", 3)),
    [("DML002", "w = 0"), ("DML108", "w = 1"), ("DML111", "w = 3"), ("gaussdb:GDML004", "v = 0 AND w = 4"), ("gaussdb:GDML002", "v = 0 AND t > 0"), ("gaussdb:GDML003", "v = 1 AND t > 0")],
)
ORACLES["rules_on_shapes"] = _fires(_PARTS(("c", 3), ("n", 9), ("j", 2), ("e", 3)), [("DML102", "c = 1"), ("DML110", "n + 1 + j > 5"), ("DML006", "j = 1"), ("DML101", "j = 1"), ("DML107", "e = 2")])
ORACLES["rules_on_lengths"] = """
SELECT 'o/' || o_orderkey || '.sql' AS file_path, 'gaussdb:GPERF001' AS rule_id, 'statement is ' || n || ' bytes, exceeding the recommended 5120 bytes; consider splitting it' AS message
FROM (SELECT o_orderkey, 28 + 4990 + o_orderkey % 200 AS n FROM orders) WHERE n > 5120
"""
ORACLES["rules_on_tables"] = """
WITH g AS (SELECT o_orderkey AS k, o_orderkey % 4 AS t, 't' || repeat('x', CAST(55 + o_orderkey % 13 AS INTEGER)) AS name, o_orderkey % 14 AS c FROM orders)
SELECT 'o/' || k || '.sql' AS file_path, rule_id, message FROM (
  SELECT k, 'gaussdb:GNAM004' AS rule_id, 'object name ''' || name || ''' is ' || length(name) || ' bytes, exceeding the 63-byte limit' AS message FROM g WHERE t = 0 AND length(name) > 63
  UNION ALL SELECT k, 'gaussdb:GNAM001', 'object name ''"a-' || k || '"'' must contain only letters, digits and underscores' FROM g WHERE t = 1
  UNION ALL SELECT k, 'gaussdb:GNAM002', 'object name ''"a-' || k || '"'' must not be defined with quotes' FROM g WHERE t = 1
  UNION ALL SELECT k, 'DDL007', 'Table name ''a-' || k || ''' contains invalid character ''-'' (only lowercase letters, digits, and underscores are allowed); table names must contain only lowercase letters, digits, and underscores, and must not start with a digit' FROM g WHERE t = 1
  UNION ALL SELECT k, 'gaussdb:GTYP001', 'table ''t' || k || ''' has ' || c || ' large fields (max 8): ' || array_to_string(list_transform(range(1, c + 1), lambda i: 'c' || i), ', ') FROM g WHERE t = 2 AND c > 8)
"""
ORACLES["dialect_fallback"] = """
SELECT 'o/' || o_orderkey || '.sql' AS file_path, dialect, CASE WHEN t = 4 OR (t = 6 AND dialect = 'mysql') THEN 'PARSE_ERROR' ELSE 'SELECT' END AS kind,
  CASE WHEN t = 4 OR (t = 6 AND dialect = 'mysql') THEN NULL ELSE t = 0 END AS is_except, CASE WHEN t = 4 OR (t = 6 AND dialect = 'mysql') THEN NULL ELSE t = 5 AND dialect <> 'mysql' END AS unqualified
FROM (SELECT o_orderkey, o_orderkey % 7 AS t FROM orders), (VALUES ('postgresql'), ('mysql'), ('oracle'), ('gaussdb')) d(dialect)
"""
ORACLES["check_diff"] = """
WITH o AS (SELECT o_orderkey AS k, 'o/' || o_orderkey || '.sql' AS file_path, o_orderkey % 4 + 1 AS h, o_orderkey % 7 = 0 AS is_new FROM orders WHERE o_orderkey % 3 <> 0)
SELECT file_path, rule_id, CAST(n AS BIGINT) AS line FROM o, (VALUES ('DML002', 1), ('DML002', 2), ('DML001', 3)) v(rule_id, n) WHERE is_new OR n = h
UNION ALL SELECT file_path, 'FILE002', CAST(1 AS BIGINT) FROM o WHERE k % 5 = 0
"""
ORACLES["mapper_includes"] = """
SELECT 'm/' || o_orderkey || '.xml' AS file_path, 'm' || o_orderkey || '.' || CASE WHEN o_orderkey % 2 = 0 THEN 'd' ELSE 'q' END AS statement_id, CAST(o_orderkey % 5 + 1 AS BIGINT) AS raw_xml_line,
  CASE WHEN o_orderkey % 2 = 0 THEN 'DELETE FROM u' || o_orderkey ELSE 'SELECT c' || o_orderkey % 50 || ', d, e FROM t WHERE id = ' || o_orderkey END AS sql_all FROM orders
"""
ORACLES["mapper_lines"] = "SELECT 'm/' || o_orderkey || '.xml' AS file_path, 'DML002' AS rule_id, CAST(o_orderkey % 5 + 1 AS BIGINT) AS line, CAST(o_orderkey % 5 + 1 AS BIGINT) AS end_line FROM orders WHERE o_orderkey % 2 = 0"
ORACLES["bound_parameters"] = """
SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey % 4 AS INTEGER) AS placeholders, c_custkey % 3 = 0 AS has_fixture,
  array_to_string(list_transform(range(1, c_custkey % 4 + 1), lambda i: CASE WHEN c_custkey % 3 <> 0 OR i > 2 THEN 'null' WHEN i = 1 THEN 'v' || c_custkey ELSE 'null' END), ',') AS bound FROM customer
"""
ORACLES["select_accessors"] = """
SELECT 'o/' || o_orderkey || '.sql' AS file_path, CASE o_orderkey % 4 WHEN 0 THEN 'a, b DESC' WHEN 1 THEN 'a ASC NULLS LAST' ELSE '' END AS order_by_text, o_orderkey % 4 = 0 AS order_by_without_direction, o_orderkey % 4 = 0 AS order_by_without_nulls,
  o_orderkey % 4 = 2 AS has_cross_join, o_orderkey % 4 = 3 AS join_without_condition, o_orderkey % 4 >= 2 AS uses_a FROM orders
"""
ORACLES["user_rules"] = """
SELECT 'o/' || o_orderkey || '.sql' AS file_path, 'LOCAL1' AS rule_id, 'LIMIT of ' || 's' || o_orderkey AS message, CAST(1 AS BIGINT) AS line FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'o/' || o_orderkey || '.sql', 'LOCAL2', 'Rule script not found: rules/none.sql', NULL FROM orders
UNION ALL SELECT 'o/' || o_orderkey || '.sql', 'LOCAL3', 'Rule execution error', NULL FROM orders
"""
ORACLES["explain_tree"] = _facts(3, ["tree"], [
    (0, '[1] CREATE_TABLE  (line 1, end_line 1, col 1)\n  table: t{k}\n  has_primary_key: true\n  primary_key_columns: ["id"]\n  columns:\n    - id INT  [pk]\n    - n VARCHAR(10)  [not_null]\n      default: \'x\''),
    (1, '[1] SELECT  (line 1, end_line 1, col 1)\n  select 0\n    projection: ["a{k}", "b.c AS d"]\n    flags: is_distinct, has_limit, has_order_by\n    tables: ["t"]\n    joins:\n      - LEFT b ON t.i = b.i\n    where: a > 1\n    order_by: a DESC'),
    (2, "[1] DELETE  (line 2, end_line 2, col 1)\n  table: t{k}\n  where: (none)\n[2] PARSE_ERROR  (line 3, end_line 3, col 1)\nComments:\n  [LINE] line 1: note"),
])
_E = ["left_table", "left_column", "right_table", "right_column", "join_type"]
_EDGES = [(0, "orders", "customer_id", "customer", "id", "INNER"), (1, "customer", "id", "orders", "customer_id", "LEFT"), (2, "lineitem", "part_id", "part", "id", "IMPLICIT"), (4, "nation", "region_id", "region", "region_id", "INNER")]
ORACLES["relation_edges"] = _facts(6, _E, _EDGES)
ORACLES["relation_list"] = """
WITH n AS (SELECT o_orderkey % 6 AS t, count(*) AS c, min('o/' || o_orderkey || '.sql') AS p FROM orders GROUP BY 1)
SELECT 'orders' AS from_table, 'customer_id' AS from_column, 'customer' AS to_table, 'id' AS to_column, 'directed' AS direction, 'INNER,LEFT' AS join_types, CAST(sum(c) AS BIGINT) AS occurrences FROM n WHERE t IN (0, 1)
UNION ALL SELECT 'lineitem', 'part_id', 'part', 'id', 'directed', 'IMPLICIT', CAST(sum(c) AS BIGINT) FROM n WHERE t = 2
UNION ALL SELECT 'nation', 'region_id', 'region', 'region_id', 'undirected', 'INNER', CAST(sum(c) AS BIGINT) FROM n WHERE t = 4
"""
ORACLES["relation_stats"] = "SELECT CAST(3 AS BIGINT) AS relation_count, CAST(count(*) AS BIGINT) AS occurrence_total FROM orders WHERE o_orderkey % 6 IN (0, 1, 2, 4)"
ORACLES["relation_changed"] = _facts(6, ["left_column", "right_column"], [(t, a, b) for t, _, a, _, b, _ in _EDGES], extra="WHERE o_orderkey % 2 = 0")

_RM = [
    (0, "1", "delete", 2, 2, "DELETE FROM a{k}"), (0, "2", "delete", 3, 3, "DELETE FROM b{k}"), (1, "1", "delete", 1, 2, "DELETE FROM a{k}; -- lint-disable-line DML*, DDL001\n/* two"),
    (1, "2", "update", 3, 3, "lines */ UPDATE b SET x = 1; /* lint-disable * */ SELECT * FROM c"), (1, "3", "select", 3, 3, "lines */ UPDATE b SET x = 1; /* lint-disable * */ SELECT * FROM c"), (2, "1", "select", 1, 1, "SELECT a FROM t{k} WHERE b = NULL"),
    (2, "2", "select", 2, 3, "SELECT NVL(a, 1) FROM t\nWHERE b <> NULL"), (3, "1", "ddl", 2, 2, "CREATE TABLE t{k} (id INT PRIMARY KEY)"), (3, "2", "ddl", 5, 5, "DROP INDEX i{k}"), (4, "1", "ddl", 1, 1, "CREATE TABLE t{k} (id INT, n VARCHAR(10))"),
    (4, "2", "ddl", 2, 2, "ALTER TABLE t{k} ADD CONSTRAINT pk_t PRIMARY KEY (id)"), (4, "3", "ddl", 3, 3, "CREATE TABLE u{k} (id INT PRIMARY KEY)"), (4, "4", "ddl", 4, 4, "ALTER TABLE u{k} DROP PRIMARY KEY"),
    (5, "1", "ddl", 1, 2, "CREATE TABLE bks_a{k} AS SELECT a FROM b;\n-- NOT_BACKUP"), (5, "2", "ddl", 3, 4, "CREATE TABLE c{k} AS SELECT a FROM b"), (5, "3", "ddl", 5, 5, "CREATE TABLE d{k} AS SELECT a FROM b"), (7, "1", "select", 1, 1, "SELECT a FROM t{k} LIMIT 5; -- RANDOM_ORDER"),
]
_RMK = [(t, "o/{k}.sql#" + i, *rest) for t, i, *rest in _RM]
ORACLES["replay_manifest"] = _facts(8, ["id", "type", "line", "end_line", "sql"], _RMK, {"line": "BIGINT", "end_line": "BIGINT"}, lead="")
_RP = []
for _t, _id, _n, _ty in ((0, "m{k}.all", 1, "select"), (1, "m{k}.find", 4, "select"), (2, "m{k}.up", 2, "update"), (3, "m{k}.in", 3, "select"), (4, "m{k}.ch", 3, "select"), (5, "m{k}.d", 1, "delete"), (5, "m{k}.x", 1, "select")):
    _b = "m/{k}.xml#" + _id
    _bad = {("m{k}.up", 2), ("m{k}.in", 2)}
    for _i in range(1, _n + 1):
        _RP.append((_t, f"{_b}#v{_i}" if _n > 1 else _b, _ty, _b if _n > 1 else None, "parse error in mapper variant" if (_id, _i) in _bad else None))
ORACLES["replay_mapper"] = _facts(6, ["id", "type", "variant_of", "parse_error"], _RP, lead="")
_RC = [(t, i) for t, i, _, a, b, _ in _RMK if a <= 2 <= b]
ORACLES["replay_changed"] = _facts(8, ["id"], _RC, lead="", extra="").replace("AS id FROM", "AS id, CASE WHEN o_orderkey % 5 = 1 THEN 'added' ELSE 'modified' END AS change FROM") + " WHERE o_orderkey % 5 <> 0"
_RR = [(t, i, ty) for t, i, ty, a, b, _ in _RMK if i.endswith("#2") and a <= 3 and b >= 2]
ORACLES["replay_removed"] = _facts(8, ["id", "type"], _RR, lead="")
_ROUTE = {"SELECT": ("execute", None), "DELETE": ("execute in a rolled-back transaction", None), "UPDATE": ("execute in a rolled-back transaction", None), "INSERT": ("execute in a rolled-back transaction", None), "CREATE_TABLE": ("skip", "DDL is not replayed"), "DROP_TABLE": ("skip", "DDL is not replayed"), "PARSE_ERROR": ("skip", "parse error")}
ORACLES["replay_routing"] = _facts(16, ["id", "action", "reason"], [(i, "o/{k}.sql#1", *_ROUTE[k]) for i, k in enumerate(_KIND16)], lead="")
ORACLES["parameter_findings"] = "SELECT CAST(c_custkey AS VARCHAR) AS stmt_id, 'PARAM001' AS code FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'DYN003' FROM customer WHERE c_custkey % 50 = 0"
ORACLES["replay_report"] = """
SELECT count(*) AS total, count(*) FILTER (event_type NOT IN ('error', 'view')) AS executed, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (value > 10 AND value <= 100) AS slow_warn,
  count(*) FILTER (value > 100) AS slow_error, CAST(sum(event_id % 3) AS BIGINT) AS findings, CAST(1 AS INTEGER) AS exit_code FROM events
"""
ORACLES["plan_tree"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS stmt_id, CAST(p AS INTEGER) AS parent_id, CAST(c AS INTEGER) AS child_idx, node_type, relation, index_name, CAST(cost AS DOUBLE) AS total_cost, CASE WHEN n = 1 THEN CAST(1 AS BIGINT) ELSE o_orderkey END AS plan_rows, has_actual
FROM orders, (VALUES (-1, 0, 'Nested Loop', NULL, NULL, 0.0, 0, false), (0, 0, 'Seq Scan', 'orders', NULL, 0.0, 0, true), (0, 1, 'Index Scan', NULL, 'i', 1.5, 1, false)) f(p, c, node_type, relation, index_name, cost, n, has_actual)
"""
_PN = "SELECT CAST(l_orderkey AS VARCHAR) AS stmt_id, l_linenumber - 1 AS node_id, CASE (l_linenumber - 1) % 5 WHEN 0 THEN 'Seq Scan' WHEN 1 THEN 'Nested Loop' WHEN 2 THEN 'Sort' WHEN 3 THEN 'Bitmap Heap Scan' ELSE 'Streaming(type: REDISTRIBUTE)' END AS node_type, CAST(l_quantity * 5000 AS BIGINT) AS r, l_suppkey AS a, l_linestatus = 'F' AS h FROM lineitem"
ORACLES["plan_findings_pg"] = f"""
WITH n AS ({_PN})
SELECT stmt_id, 'DP001' AS code, node_id, node_type FROM n WHERE node_type = 'Seq Scan' AND r > 10000 UNION ALL SELECT stmt_id, 'DP003', node_id, node_type FROM n WHERE node_type = 'Sort' AND r > 10000
UNION ALL SELECT stmt_id, 'DP004', node_id, node_type FROM n WHERE h AND r > 0 AND abs(a - r) / CAST(r AS DOUBLE) > 10 UNION ALL SELECT stmt_id, 'DP007', node_id, node_type FROM n WHERE node_type = 'Bitmap Heap Scan' AND r > 10000
UNION ALL SELECT stmt_id, 'DP008', node_id, node_type FROM n WHERE node_type LIKE 'Streaming%' AND r > 100000
UNION ALL SELECT p.stmt_id, 'DP002', p.node_id, p.node_type FROM n p JOIN n c ON p.stmt_id = c.stmt_id AND c.node_id = p.node_id + 1 WHERE p.node_type = 'Nested Loop' AND c.r > 1000
"""
ORACLES["plan_findings_mysql"] = """
WITH n AS (SELECT l_orderkey || '-' || l_linenumber AS stmt_id, l_linenumber AS k, CAST(l_quantity * 1000 AS BIGINT) AS r FROM lineitem)
SELECT stmt_id, 'DP001' AS code FROM n WHERE k % 2 = 0 AND r > 10000 UNION ALL SELECT stmt_id, 'DP003' FROM n WHERE k % 4 = 0 AND r > 10000 UNION ALL SELECT stmt_id, 'DP006' FROM n WHERE k % 4 = 1
UNION ALL SELECT stmt_id, 'DP009' FROM n WHERE k % 2 = 0 AND k % 3 = 0 AND r > 0
"""
ORACLES["timing_stats"] = """
WITH t AS (SELECT user_id, value * 10 AS ms FROM events), s AS (SELECT user_id, count(*) AS n, min(ms) AS a, quantile_cont(ms, 0.5) AS b, max(ms) AS m, quantile_disc(ms, 0.99) AS q, avg(ms) AS d FROM t GROUP BY user_id)
SELECT user_id, n, round(a, 4) AS min_ms, round(b, 4) AS p50_ms, round(CASE WHEN n < 100 THEN m ELSE q END, 4) AS p99_ms, round(d, 4) AS avg_ms, CASE WHEN b >= 1000 THEN 'error' WHEN b >= 100 THEN 'warn' ELSE 'none' END AS level FROM s
"""
_RB = ["stmt_kind", "target_table", "has_backup", "has_rollback", "reliable", "partial", "irreversible", "counter_unrestored", "requires_lock", "lock_type", "review_level"]
_RBT = dict.fromkeys(_RB[2:9], "BOOLEAN")


def _rb(i, k):
    if k == "SELECT":
        return (i, k, "", False, False, False, False, True, False, False, None, "required")
    if k == "PARSE_ERROR":
        return (i, k, "", False, False, False, False, True, False, False, None, "required")
    if k == "INSERT":
        return (i, k, "orders", False, True, False, False, False, False, False, None, "required")
    if k in ("UPDATE", "DELETE"):
        return (i, k, "orders", True, True, False, False, False, False, True, "SNAPSHOT", "required")
    if k == "CREATE_TABLE":
        return (i, k, "t_{k}", False, True, False, False, False, False, False, None, "required")
    return (i, k, "t_{k}", True, True, False, True, False, False, True, "FTWRL", "required")


_RBROWS = [_rb(i, k) for i, k in enumerate(_KIND16)]
ORACLES["rollback_pairs"] = _facts(16, _RB, _RBROWS, _RBT)
ORACLES["rollback_sql"] = _facts(5, ["rollback"], [(0, 'DROP TABLE IF EXISTS "T{k}";'), (1, 'ALTER TABLE "t" DROP COLUMN "x{k}";\nALTER TABLE "t" RENAME COLUMN "b" TO "a";\nALTER TABLE "t" DROP CONSTRAINT "fk";'), (2, 'ALTER TABLE "u{k}" RENAME TO "t";'), (3, 'DROP VIEW IF EXISTS "v{k}";'), (4, 'DROP INDEX IF EXISTS "i{k}";')])
# a name all in upper case is folded: T{k} becomes t{k}
ORACLES["rollback_sql"] = ORACLES["rollback_sql"].replace('"T{k}"', '"t{k}"')
# texts of backup and rollback by kind; T: table, B: backup, S: shadow, O: old copy (all quoted), N: the bare name
_PG_LIKE = "(LIKE {x} INCLUDING DEFAULTS INCLUDING CONSTRAINTS INCLUDING INDEXES INCLUDING COMMENTS INCLUDING GENERATED)"


def _rollback_texts(mysql: bool) -> list[tuple[int, str, str]]:
    q = "`" if mysql else '"'
    like = lambda x: f"LIKE {x}" if mysql else _PG_LIKE.replace("{x}", x)
    schema = "DATABASE()" if mysql else "current_schema()"
    table = f"  SELECT 1 FROM information_schema.tables\n  WHERE table_schema={schema} AND table_name='@N'\n)"
    check = "-- schema check: table exists\n" + (f"SELECT IF(EXISTS(\n{table}, 1, 0)" if mysql else f"SELECT EXISTS(\n{table}") + f" AS {q}check_table_exists{q};\n-- schema check: row count\nSELECT COUNT(*) AS {q}check_row_count{q} FROM @T;\n"
    part = f"SELECT partition_method AS {q}check_partition{q}\nFROM information_schema.partitions\nWHERE table_schema=DATABASE() AND table_name='@N';\n" if mysql else f"SELECT partition_strategy AS {q}check_partition{q}\nFROM pg_partitions\nWHERE schemaname=current_schema() AND tablename='@N';\n"
    check_part = "-- partition check: rows mean a partitioned table\n" + part
    copy = lambda where: ("FLUSH TABLES WITH READ LOCK;\n" if mysql else "LOCK TABLE @T IN ACCESS SHARE MODE;\n") + f"DROP TABLE IF EXISTS @B;\nCREATE TABLE @B {like('@T')};\nINSERT INTO @B SELECT * FROM @T{where};" + ("\nUNLOCK TABLES;" if mysql else "")
    off, on = ("SET FOREIGN_KEY_CHECKS=0;\n", "\nSET FOREIGN_KEY_CHECKS=1;") if mysql else ("", "")
    rebuild = f"-- rebuilt from the backup\n{off}CREATE TABLE @T {like('@B')};\nINSERT INTO @T SELECT * FROM @B;{on}"
    switch = f"-- atomic switch: the table is kept as its _old copy\n{off}DROP TABLE IF EXISTS @O;\nDROP TABLE IF EXISTS @S;\nCREATE TABLE @S LIKE @B;\nINSERT INTO @S SELECT * FROM @B;\nRENAME TABLE @T TO @O, @S TO @T;{on}\n-- after a check, cleanup drops @O"
    inside = f"-- inside a transaction\nDROP TABLE IF EXISTS @T;\nCREATE TABLE @T {like('@B')};\nINSERT INTO @T SELECT * FROM @B;"
    back = "INSERT INTO @T SELECT * FROM @B;"
    full = f"{check}\n{check_part}\n"
    return [(0, f"{check}\n{copy('')}", full + rebuild), (1, f"{check}\n{copy('')}", full + (switch if mysql else inside)), (2, copy(""), back), (3, copy(" WHERE a = 1"), back)]


def _named(column: str, q: str) -> str:
    """The text with its names filled in; four digits at least in numbers."""
    number = "lpad(CAST(seq AS VARCHAR), CAST(greatest(4, length(CAST(seq AS VARCHAR))) AS INTEGER), '0')"
    old = "lpad(CAST(seq AS VARCHAR), 4, '0')"
    names = {"@T": "'t' || k", "@B": f"'bks_t' || k || '_20240101_' || {number}", "@S": f"'_rb_' || {number} || '_t' || k", "@O": f"'t' || k || '_old_' || {old}"}
    for mark, name in names.items():
        column = f"replace({column}, '{mark}', '{q}' || {name} || '{q}')"
    return f"replace({column}, '@N', 't' || k)"


def _dialect_texts(dialect: str) -> str:
    values = ", ".join(f"({t}, {_v(b)}, {_v(r)})" for t, b, r in _rollback_texts(dialect == "mysql"))
    q = "`" if dialect == "mysql" else '"'
    return f"SELECT 'o/' || k || '.sql' AS file_path, '{dialect}' AS dialect, {_named('b', q)} AS backup_sql, {_named('r', q)} AS rollback_sql FROM n JOIN (VALUES {values}) f(t, b, r) ON n.k % 4 = f.t"


ORACLES["rollback_texts"] = "WITH n AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY 'o/' || o_orderkey || '.sql') AS seq FROM orders) " + " UNION ALL ".join(_dialect_texts(d) for d in ("mysql", "postgresql", "gaussdb"))
ORACLES["rollback_replace"] = """
SELECT 'o/' || o_orderkey || '.sql' AS file_path, 'REPLACE' AS stmt_kind, CASE o_orderkey % 2 WHEN 0 THEN '"t" WHERE "id" IN (' || o_orderkey || ', 2)' ELSE '"u"' END AS old_rows, true AS partial, true AS reliable, true AS requires_lock,
  CASE o_orderkey % 2 WHEN 0 THEN 'REPLACE rollback incomplete: cannot DELETE newly inserted rows statically, manual cleanup required' ELSE 'no primary key, full table backup' END AS warning FROM orders
"""
ORACLES["rollback_names"] = """
WITH o AS (SELECT o_orderkey, 'o/' || o_orderkey || '.sql' AS file_path, o_orderkey % 16 AS t FROM orders), n AS (SELECT *, row_number() OVER (ORDER BY file_path) AS seq, sum(CASE WHEN t IN (2, 3, 13) THEN 1 ELSE 0 END) OVER (ORDER BY file_path) AS b FROM o)
SELECT file_path, CAST(seq AS BIGINT) AS seq, 'bks_' || CASE WHEN t = 13 THEN 't_' || o_orderkey ELSE 'orders' END || '_20240101_' || lpad(CAST(b AS VARCHAR), CAST(greatest(4, length(CAST(b AS VARCHAR))) AS INTEGER), '0') AS backup_table FROM n WHERE t IN (2, 3, 13)
"""
_C = lambda cond: f"count(*) FILTER (o_orderkey % 16 IN ({cond}))"
ORACLES["rollback_manifest"] = f"""
SELECT count(*) AS statement_count, {_C("2, 3, 13")} AS backup_count, {_C("2, 3, 4, 12, 13")} AS rollback_count, count(*) AS unreliable_count, {_C("0, 1, 5, 6, 7, 8, 9, 10, 11, 14, 15")} AS irreversible_count, {_C("13")} AS partial_count,
  CAST(0 AS BIGINT) AS counter_unrestored_count, {_C("2, 3, 13")} AS requires_lock_count, CAST(0 AS BIGINT) AS partitioned_count, {_C("13")} AS irreversible_if_backup_missing_count, count(*) AS required_review_count, CAST(0 AS BIGINT) AS optional_review_count,
  CAST(0 AS BIGINT) AS auto_approved_count, CAST(2 AS INTEGER) AS exit_code FROM orders
"""
ORACLES["lock_groups"] = """
WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) AS file_path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, CASE WHEN l_quantity > 5 THEN l_returnflag END AS x, l_linestatus = 'O' AS f FROM lineitem),
j AS (SELECT *, CASE WHEN x IS NOT NULL AND f AND lag(x) OVER (PARTITION BY file_path ORDER BY seq) = x THEN 0 ELSE 1 END AS n FROM r)
SELECT file_path, seq, CAST(sum(n) OVER (PARTITION BY file_path ORDER BY seq) AS BIGINT) AS lock_group FROM j
"""
ORACLES["rollback_scripts"] = """
SELECT 'o/' || o_orderkey || '.sql' AS file_path, CASE o_orderkey % 2 WHEN 0 THEN 'source=o/' || o_orderkey || '.sql:1' || chr(10) || 'DROP VIEW IF EXISTS `b' || o_orderkey || '`;' || chr(10) || 'source=o/' || o_orderkey || '.sql:1' || chr(10) || 'DROP TABLE IF EXISTS `a' || o_orderkey || '`;' ELSE '' END AS rollback_sql FROM orders
"""
ORACLES["rollback_review"] = "SELECT 'required' AS review_level, k AS stmt_kind, count(*) AS n FROM orders JOIN (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(_KIND16)) + ") f(t, k) ON o_orderkey % 16 = f.t GROUP BY 2"
_PL = [(t, f"[{_SEV[i].upper()}] o/{{k}}.sql:1{'' if c is None else ':1'} {i} ({n}): {m}") for t, _, i, n, _, m, _, c in _DEFAULT]
ORACLES["report_lines"] = _facts(16, ["line"], _PL, lead="")
_ERR = ", ".join(str(t) for t, _, i, *_ in _DEFAULT if _SEV[i] == "error")
_ALLT = "(VALUES " + ", ".join(f"({t}, '{i}', '{g}', {_v(_SEV[i] == 'error')})" for t, _, i, _, g, *_ in _DEFAULT) + ") f(t, rule_id, rule_group, e)"
ORACLES["report_summary"] = f"SELECT false AS passed, count(*) AS total, count(*) FILTER (e) AS errors, count(*) FILTER (NOT e) AS warnings FROM orders JOIN {_ALLT} ON o_orderkey % 16 = f.t"
ORACLES["report_by_rule"] = f"SELECT rule_group, rule_id, count(*) AS n, count(*) FILTER (e) AS errors FROM orders JOIN {_ALLT} ON o_orderkey % 16 = f.t GROUP BY ROLLUP (rule_group, rule_id)"
ORACLES["exit_status"] = "SELECT true AS failed"
ORACLES["cache_misses"] = "SELECT CAST(doc_id AS VARCHAR) AS file_path, n_chars AS size FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0"
ORACLES["lock_file"] = "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256 FROM documents"
