"""Identifier functions as SQL expression text and as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved words and object-name prefixes.
RESERVED_WORDS = [
    "SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE", "INTO", "VALUES", "SET", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS",
    "ON", "USING", "UNION", "ALL", "INTERSECT", "EXCEPT", "ORDER", "BY", "GROUP", "HAVING", "LIMIT", "OFFSET", "FETCH", "DISTINCT", "AS", "WITH",
    "RECURSIVE", "CREATE", "TABLE", "INDEX", "VIEW", "DROP", "ALTER", "ADD", "MODIFY", "CHANGE", "RENAME", "TRUNCATE", "SCHEMA", "DATABASE",
    "SEQUENCE", "CONSTRAINT", "PRIMARY", "FOREIGN", "REFERENCES", "DEFAULT", "CHECK", "UNIQUE", "KEY", "COLUMN", "AND", "OR", "NOT", "IN", "EXISTS",
    "BETWEEN", "LIKE", "IS", "NULL", "TRUE", "FALSE", "CASE", "WHEN", "THEN", "ELSE", "END", "IF", "BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT",
    "GRANT", "REVOKE", "RETURN", "CASCADE", "RESTRICT", "USER", "ROLE", "PUBLIC", "SESSION", "TRANSACTION", "LOCK", "CAST", "CONVERT", "NATURAL",
    "ESCAPE", "TEMPORARY", "TEMP", "INT", "INTEGER", "SMALLINT", "BIGINT", "DECIMAL", "NUMERIC", "FLOAT", "REAL", "DOUBLE", "CHAR", "VARCHAR",
    "TEXT", "DATE", "TIME", "TIMESTAMP", "INTERVAL", "BOOLEAN", "BLOB", "BINARY", "CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP",
    "CURRENT_USER",
]
RESERVED_PREFIXES = ["pg_", "gs_", "adm_", "my_", "db_"]


def strip_quotes(x: str) -> str:
    return f"regexp_replace(trim({x}), '^[\"`]|[\"`]$', '')"


def leaf(x: str) -> str:
    """Last part of a dotted name, without quotes."""
    return strip_quotes(f"element_at(split({x}, '[.]'), -1)")


def normalize(x: str) -> str:
    return f"lower({leaf(x)})"


def is_valid(x: str) -> str:
    return f"(trim({x}) rlike '^[A-Za-z_][A-Za-z0-9_]*$')"


def is_quoted(x: str) -> str:
    return f"(trim({x}) rlike '^(\".*\"|`.*`)$')"


def is_reserved(x: str) -> str:
    return f"(upper({leaf(x)}) in ({', '.join(repr(w) for w in RESERVED_WORDS)}))"


def has_reserved_prefix(x: str) -> str:
    return "(" + " or ".join(f"startswith({normalize(x)}, '{p}')" for p in RESERVED_PREFIXES) + ")"


def length_bytes(x: str) -> str:
    return f"octet_length({x})"


FUNCTIONS = {
    "strip_quotes": strip_quotes, "ident_leaf": leaf, "normalize_ident": normalize, "is_valid_ident": is_valid, "is_quoted_ident": is_quoted,
    "is_reserved_word": is_reserved, "has_reserved_prefix": has_reserved_prefix, "len_bytes": length_bytes,
}


def column(function: str, name: str) -> Column:
    return F.expr(FUNCTIONS[function](name))
