"""The parse result of a file as an indented text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _q(x: str) -> str:
    return "'" + x.replace("'", "\\'") + "'"


def _line(depth: int, label: str, value: str, unless: str = "false") -> str:
    """One line, or none where `unless` holds or the value is null."""
    text = f"concat({_q('  ' * depth + label + ': ')}, cast({value} as string))"
    return f"if({unless} or {value} is null, cast(array() as array<string>), array({text}))"


def _list(depth: int, label: str, values: str) -> str:
    shown = f"concat('[', array_join(transform({values}, v -> concat('\"', v, '\"')), ', '), ']')"
    return _line(depth, label, shown, f"coalesce(size({values}), 0) = 0")


def _all(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _rows(depth: int, label: str, rows: str, name: str, body: str) -> str:
    """A heading and the lines of each element; nothing for an empty array."""
    return f"if(coalesce(size({rows}), 0) = 0, cast(array() as array<string>), concat(array({_q('  ' * depth + label + ':')}), flatten(transform({rows}, {name} -> {body}))))"


def _flags(pairs: list[tuple[str, str]]) -> str:
    listed = ", ".join(f"if({c}, {_q(n)}, null)" for c, n in pairs)
    return f"array_join(array_compact(array({listed})), ', ')"


def _column() -> str:
    flags = _flags([("c.primary_key", "pk"), ("not c.nullable", "not_null"), ("c.is_unique", "unique"), ("c.auto_increment", "auto_inc")])
    head = f"array(concat('    - ', c.name, ' ', c.data_type, if({flags} = '', '', concat('  [', {flags}, ']'))))"
    return _all(head, _line(3, "default", "c.default_value"), _line(3, "comment", "c.comment"))


def _create(t: str = "s.create_table") -> str:
    key = _all("array(concat('    - name: ', if(k.name = '', '(unnamed)', k.name)))", _list(3, "columns", "k.columns"), _line(3, "references", "k.ref_table"), _list(3, "referred", "k.ref_columns"))
    named = lambda n: _all(f"array(concat('    - name: ', if({n}.name = '', '(unnamed)', {n}.name)))", _list(3, "columns", f"{n}.columns"))
    return _all(
        _line(1, "table", f"{t}.table_name"), _line(1, "if_not_exists", f"{t}.if_not_exists", f"not {t}.if_not_exists"), _line(1, "is_create_as", f"{t}.is_ctas", f"not {t}.is_ctas"), _line(1, "has_primary_key", f"{t}.has_primary_key"),
        _list(1, "primary_key_columns", f"{t}.primary_key_columns"), _line(1, "primary_key_name", f"{t}.primary_key_name", f"{t}.primary_key_name = ''"), _rows(1, "columns", f"{t}.columns", "c", _column()),
        _rows(1, "foreign_keys", f"{t}.foreign_keys", "k", key), _rows(1, "checks", f"{t}.checks", "k", "array(concat('    - ', if(length(k.expression) > 80, concat(left(k.expression, 77), '...'), k.expression)))"),
        _rows(1, "indexes", f"{t}.indexes", "x", named("x")), _rows(1, "uniques", f"{t}.uniques", "x", named("x")),
    )


def _select() -> str:
    yes = ["has_wildcard", "is_distinct", "is_union", "is_union_all", "is_intersect", "is_except", "has_limit", "has_offset", "has_fetch", "has_order_by", "has_group_by", "has_from_subquery"]
    flags = _flags([(f"x.{n}", n) for n in yes])
    join = "array(concat('      - ', j.join_type, ' ', j.table_name, if(j.alias = '', '', concat(' AS ', j.alias)), if(j.condition_text = '', '', concat(' ON ', j.condition_text))))"
    body = _all(
        "array(concat('  select ', x.select_id, if(x.parent_id < 0, '', concat(' in ', x.parent_id))))", _list(2, "projection", "x.projection"), _line(2, "flags", flags, f"{flags} = ''"), _list(2, "tables", "x.from_tables"),
        _rows(2, "joins", "x.joins", "j", join), _line(2, "where", "x.where_clause"), _list(2, "group_by", "x.group_by"), _line(2, "having", "x.having"), _line(2, "order_by", "x.order_by_text", "x.order_by_text = ''"), _list(2, "ctes", "x.cte_names"),
    )
    return f"flatten(transform(coalesce(s.selects, array()), x -> {body}))"


def _changed() -> str:
    """INSERT, UPDATE and DELETE."""
    where = lambda t: _line(1, "where", f"if({t} is null, null, coalesce({t}.where_clause, '(none)'))")
    return _all(
        _line(1, "table", "s.insert.table_name"), _list(1, "columns", "s.insert.columns"), _line(1, "table", "s.update.table_name"), _list(1, "set", "s.update.set_columns"), where("s.update"),
        _line(1, "table", "s.delete.table_name"), where("s.delete"), _line(1, "table", "s.truncate.table_name"),
    )


def _objects() -> str:
    """DROP, ALTER, CREATE VIEW and CREATE INDEX."""
    op = _all(
        "array(concat('    - type: ', o.operation_type))", _line(3, "column", "o.column_name", "o.column_name = ''"), _line(3, "constraint", "o.constraint_name", "o.constraint_name = ''"), _line(3, "detail", "o.detail", "o.detail = ''")
    )
    return _all(
        _line(1, "type", "s.drop.object_type"), _line(1, "name", "s.drop.name"), _line(1, "if_exists", "s.drop.if_exists"), _line(1, "table", "s.alter.table_name"), _line(1, "adds_primary_key", "s.alter.adds_primary_key"),
        _line(1, "drops_primary_key", "s.alter.drops_primary_key"), _list(1, "added_pk_columns", "s.alter.added_primary_key_columns"), _rows(1, "operations", "s.alter.ops", "o", op), _line(1, "name", "s.view.name"),
        _line(1, "materialized", "s.view.materialized"), _line(1, "name", "s.create_index.name"), _line(1, "table", "s.create_index.table_name"), _list(1, "columns", "s.create_index.columns"), _line(1, "is_unique", "s.create_index.is_unique"),
    )


def tree() -> str:
    """Expression of the text over `ast`: a heading for each statement, what was recognised in it, then comments."""
    head = "array(concat('[', i + 1, '] ', s.kind, '  (line ', s.line, ', end_line ', s.end_line, ', col ', s.`column`, ')'))"
    body = f"flatten(transform(ast.statements, (s, i) -> {_all(head, f'if(s.create_table is null, cast(array() as array<string>), {_create()})', _objects(), _changed(), _select())}))"
    notes = _rows(0, "Comments", "ast.comments", "c", "array(concat('  [', c.kind, '] line ', c.line, ': ', if(length(c.text) > 60, concat(left(c.text, 57), '...'), c.text)))")
    none = "if(size(ast.statements) = 0, array('(no statements parsed)'), cast(array() as array<string>))"
    failed = "if(ast.parse_error is null, cast(array() as array<string>), array(concat('parse error: ', ast.parse_error)))"
    comma = "if(ast.has_comma_join_anywhere, array('Has comma JOIN (implicit): true'), cast(array() as array<string>))"
    return f"array_join({_all(failed, comma, none, body, notes)}, '\\n')"


def explain_text(asts: DataFrame) -> DataFrame:
    """(file_path, tree) of parsed scripts."""
    return asts.select("file_path", F.expr(tree()).alias("tree"))
