"""Texts of violations. Names in braces are filled in; `@` is a rule's limit."""

# Results must carry these texts.
MESSAGES = {
    "DDL001": "DROP TABLE is not allowed in DDL scripts, use a dedicated migration instead: {n}",
    "DDL002.removed": "CREATE TABLE {n} declares a PRIMARY KEY but it is removed by ALTER TABLE ... DROP PRIMARY KEY, leaving the table without a primary key",
    "DDL002.missing": "CREATE TABLE {n} must include a PRIMARY KEY (column constraint, table constraint, or ALTER TABLE ... ADD PRIMARY KEY)",
    "DDL003.table": "Table name '{n}' uses a SQL reserved keyword, use a different name",
    "DDL003.column": "Column name '{n}' in table '{t}' uses a SQL reserved keyword",
    "DDL003.index": "Index name '{n}' uses a SQL reserved keyword",
    "DDL003.view": "View name '{n}' uses a SQL reserved keyword",
    "DDL003.unique": "Unique constraint name '{n}' uses a SQL reserved keyword",
    "DDL004": "Backup table created via CREATE TABLE AS SELECT must be named with 'bks_' prefix, or add a comment containing 'NOT_BACKUP' on the same or previous line to mark it as not a backup table: {n}",
    "DDL005.index": "Non-unique index '{i}' on table '{t}' should be named '{e}' (idx_table_field_field)",
    "DDL005.unique": "Unique constraint '{i}' on table '{t}' should be named '{e}' (uk_table_field_field)",
    "DDL005.primary": "Primary key constraint '{i}' on table '{t}' should be named '{e}' (pk_table)",
    "DDL005.create": "Index '{i}' on table '{t}' should be named '{e}' ({p}table_field_field)",
    "DDL006.equal": "Index '{i}' on table '{t}' is redundant: its columns exactly match the primary key columns ({c})",
    "DDL006.primary": "Index '{i}' on table '{t}' is redundant: its columns are a leftmost prefix of the primary key ({c}), already covered by PK",
    "DDL006.prefix": "Index '{i}' on table '{t}' is redundant: its columns ({c}) are a leftmost prefix of index '{b}' ({d})",
    "DDL007.create": "Table name '{n}' {r}; table names must contain only lowercase letters, digits, and underscores, and must not start with a digit",
    "DDL007.rename": "Renamed table name '{n}' {r}; table names must contain only lowercase letters, digits, and underscores, and must not start with a digit",
    "DDL007.digit": "starts with a digit",
    "DDL007.character": "contains invalid character '{x}' (only lowercase letters, digits, and underscores are allowed)",
    "DML001": "SELECT * is not allowed. Specify columns explicitly.",
    "DML002.delete": "DELETE without WHERE clause will remove all rows from table: {n}. Add a WHERE condition or use TRUNCATE if intentional.",
    "DML002.update": "UPDATE without WHERE clause will modify all rows in table: {n}. Add a WHERE condition.",
    "DML003": "INSERT must specify target columns explicitly: INSERT INTO {n} (col1, col2, ...) VALUES (...)",
    "DML004": "Subquery in FROM clause must have an alias: SELECT ... FROM (SELECT ...) AS alias",
    "DML005": "Column reference should be qualified with table name in multi-table query. Use table.column syntax.",
    "DML006": "JOIN without ON or USING condition causes a Cartesian product. Add an explicit join condition.",
    "DML007": "Pagination query (LIMIT/OFFSET/FETCH) without ORDER BY produces non-deterministic results. Add an ORDER BY clause, or if random ordering is intentional, add '-- RANDOM_ORDER' comment to suppress.",
    "DML101": "Possible unused JOIN to table '{t}' (alias '{a}'). The table columns are not referenced in SELECT list, WHERE, GROUP BY, HAVING or ORDER BY clause.",
    "DML102": "CTE '{c}' is defined but not referenced in the main query or its subqueries. Remove unused CTE.",
    "DML103.equal": "Use 'IS NULL' instead of '= NULL'. NULL comparisons always return FALSE with '='.",
    "DML103.other": "Use 'IS NOT NULL' instead of '<> NULL' or '!= NULL'. NULL comparisons always return FALSE with '<>'.",
    "DML104.nvl": "Use standard COALESCE() instead of Oracle-specific NVL(). COALESCE is cross-database compatible.",
    "DML104.isnull": "Use standard COALESCE() instead of T-SQL-specific ISNULL(). COALESCE is cross-database compatible.",
    "DML105": "ORDER BY in subquery is typically ignored unless combined with LIMIT/OFFSET. Consider moving ORDER BY to the outer query.",
    "DML106": "UNION performs implicit DISTINCT. Use UNION ALL if duplicate elimination is not required, or explicitly use UNION DISTINCT for clarity.",
    "DML107": "Nested CASE expressions reduce readability. Consider rewriting with simple CASE or extracting into subqueries.",
    "DML108": "Constant/tautology condition in WHERE clause ('{w}'). This always matches or never matches and is usually dead code or a dynamic-SQL placeholder. Remove it or replace with a real condition.",
    "DML109": "JOIN must specify an explicit join type (e.g. LEFT JOIN or INNER JOIN); bare JOIN is not allowed.",
    "DML110": "Query joins more than @ tables. Consider splitting the query or using a CTE/view.",
    "DML111": "WHERE clause combines conditions with OR ('{w}'). OR usually prevents efficient index utilization; prefer IN (...) for same-column values, UNION ALL for cross-column disjunctions, or splitting the query.",
    "DML111.select": "WHERE clause combines conditions with OR ('{w}'). OR usually prevents efficient index utilization; prefer IN (...) for same-column values, UNION ALL for cross-column disjunctions, or splitting the query. See docs/sql-guidelines/avoid-or-in-where.md.",
    "GNAM001.table": "object name '{n}' must contain only letters, digits and underscores",
    "GNAM001.column": "column name '{n}' must contain only letters, digits and underscores",
    "GNAM001.index": "index name '{n}' must contain only letters, digits and underscores",
    "GNAM001.view": "view name '{n}' must contain only letters, digits and underscores",
    "GNAM002.table": "object name '{n}' must not be defined with quotes",
    "GNAM002.column": "column name '{n}' must not be defined with quotes",
    "GNAM002.index": "index name '{n}' must not be defined with quotes",
    "GNAM002.view": "view name '{n}' must not be defined with quotes",
    "GNAM002.target": "index target table '{n}' must not be defined with quotes",
    "GNAM003.table": "object name '{n}' uses a system-reserved prefix (pg_/gs_/adm_/my_/db_)",
    "GNAM003.column": "column name '{n}' uses a system-reserved prefix (pg_/gs_/adm_/my_/db_)",
    "GNAM003.index": "index name '{n}' uses a system-reserved prefix (pg_/gs_/adm_/my_/db_)",
    "GNAM003.view": "view name '{n}' uses a system-reserved prefix (pg_/gs_/adm_/my_/db_)",
    "GNAM004.table": "object name '{n}' is {b} bytes, exceeding the @-byte limit",
    "GNAM004.column": "column name '{n}' is {b} bytes, exceeding the @-byte limit",
    "GNAM004.index": "index name '{n}' is {b} bytes, exceeding the @-byte limit",
    "GNAM004.view": "view name '{n}' is {b} bytes, exceeding the @-byte limit",
    "GTYP001": "table '{t}' has {n} large fields (max @): {b}",
    "GTYP002": "column '{n}' of table '{t}' uses a reserved system column name",
    "GTYP003": "column '{n}' uses non-recommended type '{d}'; prefer a GaussDB recommended basic type",
    "GOBJ001": "materialized view '{n}' is not allowed; use a regular table or view instead",
    "GOBJ002": "view '{n}' must not contain ORDER BY; let the caller sort instead",
    "GOBJ003": "view '{n}' is discouraged; prefer querying base tables (and avoid nested views)",
    "GIDX001": "CREATE INDEX '{n}' on '{t}' must use CONCURRENTLY when the system has online transactions",
    "GDCL001": "DDL must not quote column names (found quote or backtick in statement text)",
    "GDDL001": "transaction contains DDL but has no explicit COMMIT/ROLLBACK before end of file",
    "GDML002.order": "UPDATE on '{t}' must not use ORDER BY",
    "GDML002.group": "UPDATE on '{t}' must not use GROUP BY",
    "GDML003.order": "DELETE on '{t}' must not use ORDER BY",
    "GDML003.group": "DELETE on '{t}' must not use GROUP BY",
    "GDML004": "UPDATE on '{t}' has a subquery in WHERE; consider rewriting as JOIN and compare execution plans",
    "GDML005.sort": "ORDER BY must specify ASC or DESC explicitly ({o})",
    "GDML005.nulls": "ORDER BY must specify NULLS FIRST or NULLS LAST explicitly ({o})",
    "GPERF001": "statement is {b} bytes, exceeding the recommended @ bytes; consider splitting it",
}
