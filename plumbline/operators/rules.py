"""Rules as SQL expressions over the parse result; all rules of a run are one projection.

A rule is an expression that gives an array of hits (message, line, column). Level `statement` sees `s` (a statement), `r`
(its root select, null unless SELECT) and `q` (all its selects, root first); level `file` sees `statements`, `comments` and
`text` of a whole file, so rules across statements need no shuffle either. `kinds` says on which kinds of statement a rule can
hit at all; on others it is not evaluated. A user's rule is the same expression in a file of its own (`user_rule`).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path

from plumbline.functions import idents as I
from plumbline.operators.messages import MESSAGES


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    group: str
    severity: str
    enabled: bool
    applies_to: tuple[str, ...]
    level: str
    hits: str
    params: dict[str, int] = field(default_factory=dict)
    guarded: bool = True
    kinds: tuple[str, ...] = ()
    #: Why a user's rule cannot run; reported for every file that it applies to.
    problem: str = ""

    def with_params(self, **params) -> Rule:
        return replace(self, params=self.params | params)

    def expression(self) -> str:
        out = self.hits
        for k, v in self.params.items():
            out = out.replace("{" + k + "}", str(int(v)))
        return out


def hit(message: str, line: str = "s.line", column: str = "s.`column`") -> str:
    return f"named_struct('message', {message}, 'line', cast({line} as bigint), 'column', cast({column} as bigint))"


def when(condition: str, message: str, line: str = "s.line", column: str = "s.`column`") -> str:
    return f"case when {condition} then array({hit(message, line, column)}) else {NONE} end"


NONE = "cast(array() as array<struct<message:string,line:bigint,column:bigint>>)"
ONCE = ("1", "cast(null as bigint)")


def concat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def let(name: str, value: str, body: str) -> str:
    """`body` with `name` for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def each(rows: str, name: str, condition: str, row: str) -> str:
    """A hit for every element of an array that meets the condition."""
    return f"transform(filter({rows}, {name} -> {condition}), {name} -> {row})"


def text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def msg(key: str, limit: str = "", **values: str) -> str:
    """concat(...) of a message with {name} places; null values print as nothing; `@` is the parameter `limit`."""
    parts, rest = [], MESSAGES[key]
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        parts += [text(before)] if before else []
        parts.append(f"coalesce(cast({values[name]} as string), '')")
    parts += [text(rest)] if rest else []
    return f"concat({', '.join(parts)})".replace("@", "{" + limit + "}")


_T, _I, _V = "s.create_table.table_name", "s.create_index.name", "s.view.name"
_NAMED = ("CREATE_TABLE", "CREATE_INDEX", "CREATE_VIEW")


def names(rule: str, bad, limit: str = "") -> str:
    """Hits for a table's, its columns', an index's and a view's name that `bad` (expression -> expression) rejects."""
    m = lambda what, n, **more: msg(f"{rule}.{what}", limit, n=n, b=f"octet_length({n})", **more)
    return concat(
        when(f"{_T} is not null and {bad(_T)}", m("table", _T)), each("coalesce(s.create_table.columns, array())", "c", bad("c.name"), hit(m("column", "c.name", t=_T))),
        when(f"{_I} is not null and {_I} <> '' and {bad(_I)}", m("index", _I)), when(f"{_V} is not null and {bad(_V)}", m("view", _V)),
    )


_CORE: list[Rule] = []


def _core(id: str, name: str, group: str, severity: str, enabled: bool, kinds: str, hits: str, guarded: bool = True, **params) -> None:
    """`kinds`: kinds of statement, or `file` for a rule over all of them."""
    applies = ("ddl",) if id.startswith("DDL") else ("dml",)
    level = "file" if kinds == "file" else "statement"
    _CORE.append(Rule(id, name, group, severity, enabled, applies, level, hits, params, guarded, () if level == "file" else tuple(kinds.split())))


_core("DDL001", "no_drop_table", "ddl-safety", "error", True, "DROP_TABLE", when("s.kind = 'DROP_TABLE'", msg("DDL001", n="s.drop.name")))

_altered = lambda what: f"transform(filter(statements, a -> a.alter.{what}), a -> a.alter.table_name)"
_core(
    "DDL002", "primary_key_required", "ddl-safety", "warning", True, "file",
    let("added", _altered("adds_primary_key"), let("dropped", _altered("drops_primary_key"),
        "flatten(transform(filter(statements, s -> s.create_table is not null), s -> case "
        f"when s.create_table.has_primary_key and array_contains(dropped, {_T}) then array({hit(msg('DDL002.removed', n=_T))}) "
        f"when not s.create_table.has_primary_key and not array_contains(added, {_T}) then array({hit(msg('DDL002.missing', n=_T))}) "
        f"else {NONE} end))")),
)

_core(
    "DDL003", "no_reserved_keyword_naming", "ddl-safety", "error", True, " ".join(_NAMED),
    concat(
        names("DDL003", I.is_reserved), each("coalesce(s.create_table.indexes, array())", "x", I.is_reserved("x.name"), hit(msg("DDL003.index", n="x.name"))),
        each("coalesce(s.create_table.uniques, array())", "x", I.is_reserved("x.name"), hit(msg("DDL003.unique", n="x.name"))),
    ),
)

_BACKUP = f"startswith({I.normalize(_T)}, 'bks_') or exists(comments, c -> contains(c.text, 'NOT_BACKUP') and c.line in (s.line, s.line - 1))"
_core("DDL004", "backup_table_naming", "ddl-safety", "warning", True, "file", each("statements", "s", f"coalesce(s.create_table.is_ctas, false) and not ({_BACKUP})", hit(msg("DDL004", n=_T))))

_EXPECT = lambda prefix, table, cols: f"concat({prefix}, {I.normalize(table)}, '_', array_join(transform({cols}, c -> lower({I.strip_quotes('c')})), '_'))"


def _index_names(column: str, what: str, prefix: str) -> str:
    expected = _EXPECT(f"'{prefix}'", _T, "x.columns")
    return each(f"coalesce(s.create_table.{column}, array())", "x", f"x.name <> '' and lower(x.name) <> {expected}", hit(msg(f"DDL005.{what}", i="x.name", t=_T, e=expected)))


_PK_NAME, _PK = "s.create_table.primary_key_name", f"concat('pk_', {I.normalize(_T)})"
_CI_PREFIX = "if(s.create_index.is_unique, 'uk_', 'idx_')"
_CI = _EXPECT(_CI_PREFIX, "s.create_index.table_name", "s.create_index.columns")
_core(
    "DDL005", "index_naming_convention", "ddl-naming", "warning", True, "CREATE_TABLE CREATE_INDEX",
    concat(
        _index_names("indexes", "index", "idx_"), _index_names("uniques", "unique", "uk_"),
        when(f"{_PK_NAME} <> '' and lower({_PK_NAME}) <> {_PK}", msg("DDL005.primary", i=_PK_NAME, t=_T, e=_PK)),
        when(f"{_I} <> '' and lower({_I}) <> {_CI}", msg("DDL005.create", i=_I, t="s.create_index.table_name", e=_CI, p=_CI_PREFIX)),
    ),
)

# Entries of a file's non-unique indexes, in order of appearance.
_NORM = lambda cols: f"transform({cols}, c -> lower({I.strip_quotes('c')}))"
_ENTRY = lambda table, name, cols: f"named_struct('k', {I.normalize(table)}, 'name', {name}, 'cols', {_NORM(cols)}, 'line', s.line, 'col', s.`column`)"
_ENTRIES = (
    f"flatten(transform(statements, s -> case when s.create_table is not null then transform(s.create_table.indexes, x -> {_ENTRY(_T, 'x.name', 'x.columns')}) "
    f"when s.create_index is not null and not s.create_index.is_unique then array({_ENTRY('s.create_index.table_name', _I, 's.create_index.columns')}) "
    "else cast(array() as array<struct<k:string,name:string,cols:array<string>,line:bigint,col:bigint>>) end))"
)
_KEYS = f"transform(filter(statements, s -> size(s.create_table.primary_key_columns) > 0), s -> named_struct('k', {I.normalize(_T)}, 'cols', {_NORM('s.create_table.primary_key_columns')}))"
_TABLE_OF = f"coalesce({_T}, s.create_index.table_name)"
_ORIGINS = f"transform(filter(statements, s -> s.create_table is not null or not s.create_index.is_unique), s -> named_struct('k', {I.normalize(_TABLE_OF)}, 't', {_TABLE_OF}))"
_prefix = lambda a, b: f"size({a}) > 0 and size({a}) < size({b}) and slice({b}, 1, size({a})) = {a}"
_listed = lambda cols: f"array_join({cols}, ', ')"


def _redundant(key: str, **more: str) -> str:
    return f"array({hit(msg(key, i='a.name', t='get(filter(origins, o -> o.k = a.k), 0).t', **more), 'a.line', 'a.col')})"


_core(
    "DDL006", "no_redundant_index", "ddl-safety", "warning", True, "file",
    let("entries", _ENTRIES, f"case when size(entries) = 0 then {NONE} else " + let("keys", _KEYS, let("origins", _ORIGINS,
        "flatten(transform(entries, a -> " + let("pk", "try_element_at(filter(keys, p -> p.k = a.k), -1).cols", let("cover", f"get(filter(entries, b -> b.k = a.k and {_prefix('a.cols', 'b.cols')}), 0)",
            f"case when a.cols = pk then {_redundant('DDL006.equal', c=_listed('pk'))} when {_prefix('a.cols', 'pk')} then {_redundant('DDL006.primary', c=_listed('pk'))} "
            f"when cover is not null then {_redundant('DDL006.prefix', c=_listed('a.cols'), b='cover.name', d=_listed('cover.cols'))} else {NONE} end")) + "))")) + " end"),
)


def _table_name(key: str, x: str) -> tuple[str, str]:
    name = I.leaf(x)
    wrong = msg("DDL007.character", x=f"regexp_extract({name}, '[^a-z0-9_]', 0)")
    return f"({name} rlike '^[0-9]|[^a-z0-9_]')", msg(key, n=name, r=f"if({name} rlike '^[0-9]', {text(MESSAGES['DDL007.digit'])}, {wrong})")


_TBAD, _TMSG = _table_name("DDL007.create", _T)
_RBAD, _RMSG = _table_name("DDL007.rename", "o.table_name")
_core(
    "DDL007", "table_name_naming", "ddl-naming", "warning", True, "CREATE_TABLE ALTER_TABLE",
    concat(when(f"s.create_table is not null and {_TBAD}", _TMSG), each("coalesce(s.alter.ops, array())", "o", f"o.operation_type = 'RENAME_TABLE' and {_RBAD}", hit(_RMSG))),
)

_core("DML001", "no_select_all", "dml-safety", "error", True, "SELECT", when("r.has_wildcard", msg("DML001")))
_core(
    "DML002", "no_delete_update_without_where", "dml-safety", "error", True, "DELETE UPDATE",
    concat(when("s.delete is not null and s.delete.where_clause is null", msg("DML002.delete", n="s.delete.table_name")), when("s.update is not null and s.update.where_clause is null", msg("DML002.update", n="s.update.table_name"))),
)
_core("DML003", "insert_columns_required", "dml-safety", "error", True, "INSERT", when("s.insert is not null and size(s.insert.columns) = 0", msg("DML003", n="s.insert.table_name")))
_core("DML004", "subquery_alias_required", "dml-safety", "error", True, "SELECT", when("r.has_from_subquery and not r.from_subquery_has_alias", msg("DML004")))
_core("DML005", "column_references_qualified", "dml-style", "warning", True, "SELECT", when("r.has_unqualified_column", msg("DML005")))
_core("DML006", "no_join_without_condition", "dml-safety", "error", True, "SELECT", when("exists(r.joins, j -> not j.has_condition)", msg("DML006")))
_PAGED = "x.has_limit or x.has_offset or x.has_fetch"
_core(
    "DML007", "order_by_required_for_pagination", "dml-safety", "error", True, "file",
    f"case when contains(text, 'RANDOM_ORDER') then {NONE} else " + each("statements", "s", f"s.kind = 'SELECT' and exists(s.selects, x -> ({_PAGED}) and not x.has_order_by)", hit(msg("DML007"))) + " end",
)
_SEEN = f"(array_contains(r.qualifiers, upper(if(j.alias <> '', j.alias, j.table_name))) or array_contains(r.qualifiers, upper(j.table_name)) or array_contains(r.qualifiers, upper({I.leaf('j.table_name')})))"
_core("DML101", "no_unused_join", "dml-style", "warning", False, "SELECT", f"case when r.has_star then {NONE} else " + each("r.joins", "j", f"j.join_type <> 'CROSS' and not {_SEEN}", hit(msg("DML101", t="j.table_name", a="j.alias"))) + " end")
_VISIBLE = "upper(concat_ws(' ', flatten(transform(q, x -> concat(x.projection, array(coalesce(x.where_clause, '')), x.from_tables, transform(x.joins, j -> concat_ws(' ', j.table_name, j.condition_text)))))))"
_core("DML102", "no_unused_cte", "dml-style", "warning", False, "SELECT", f"case when size(r.cte_names) = 0 then {NONE} else " + let("visible", _VISIBLE, each("r.cte_names", "c", "not contains(visible, upper(c))", hit(msg("DML102", c="c")))) + " end")
_has = lambda *parts: "(" + " or ".join(f"contains(u, '{x}')" for x in parts) + ")"
_LINE_HITS = concat(
    when(f"{_has('= NULL', '=NULL')} and not {_has('IS NULL', 'IS NOT NULL')}", msg("DML103.equal"), "i + 1", "cast(null as bigint)"),
    when(f"{_has('<> NULL', '<>NULL', '!= NULL', '!=NULL')} and not {_has('IS NOT NULL')}", msg("DML103.other"), "i + 1", "cast(null as bigint)"),
)
_core("DML103", "use_is_null", "dml-style", "error", False, "file", f"case when contains(upper(text), 'NULL') then flatten(transform(split(upper(text), '\\n'), (u, i) -> {_LINE_HITS})) else {NONE} end", guarded=False)
_core("DML104", "use_coalesce", "dml-style", "warning", False, "file", concat(when("contains(upper(text), 'NVL(')", msg("DML104.nvl"), *ONCE), when("contains(upper(text), 'ISNULL(')", msg("DML104.isnull"), *ONCE)), guarded=False)
_core("DML105", "no_order_by_in_subquery", "dml-style", "warning", False, "SELECT", when(f"exists(q, x -> x.depth > 0 and x.has_order_by and not ({_PAGED}))", msg("DML105"), *ONCE))
_core("DML106", "union_all_preferred", "dml-performance", "warning", False, "SELECT", when("r.is_union and not r.is_union_all", msg("DML106")))
_core("DML107", "no_nested_case", "dml-style", "warning", False, "SELECT", when("size(split(upper(s.stmt_text), 'CASE')) > 2", msg("DML107")))

_WHERE = "coalesce(r.where_clause, s.update.where_clause, s.delete.where_clause)"
# Literals by a possessive character class: an alternation in a loop would use the stack for every character. A literal with a doubled
# quote is several such pieces.
_TOKENS = "regexp_extract_all({w}, '(\\'[^\\']*+\\'|<=|>=|<>|!=|[()=<>]|[^\\\\s()=<>!\\']+)', 1)"
_LIT = "({t} rlike '^(?i)(\\'.*\\'|-?[0-9]+([.][0-9]*)?|true|false)$')"


def constant_where(where: str) -> str:
    """The clause is one literal, or has a comparison of two literals."""
    lit = lambda t: _LIT.replace("{t}", t)
    single = let("plain", "filter(tok, t -> t not in ('(', ')'))", f"(size(plain) = 1 and {lit('get(plain, 0)')}) or (size(plain) > 1 and forall(plain, t -> startswith(t, '\\'')))")
    pair = f"exists(sequence(0, greatest(size(tok) - 3, 0)), i -> coalesce(get(tok, i + 1) in ('=', '<>', '!=', '<', '>', '<=', '>=') and {lit('get(tok, i)')} and {lit('get(tok, i + 2)')}, false))"
    return f"({where} is not null and " + let("tok", _TOKENS.replace("{w}", where), f"({single} or {pair})") + ")"


_core("DML108", "no_constant_where", "dml-safety", "warning", True, "SELECT UPDATE DELETE", when(constant_where(_WHERE), msg("DML108", w=_WHERE)))
_core("DML109", "join_type_required", "dml-style", "warning", True, "SELECT", when("exists(q, x -> exists(x.joins, j -> not j.explicit_join_type))", msg("DML109"), *ONCE))
_core("DML110", "max_join_tables", "dml-performance", "warning", True, "SELECT", when("exists(q, x -> x.table_count > {max_join_tables})", msg("DML110", "max_join_tables")), max_join_tables=5)


def has_or(where: str) -> str:
    return f"(contains(upper({where}), 'OR') and regexp_replace({where}, '\\'[^\\']*+\\'', '') rlike '(?i)(^|[\\\\s()])OR($|[\\\\s()])')"


_core(
    "DML111", "no_or_in_where", "dml-performance", "warning", True, "SELECT UPDATE DELETE",
    concat(
        when(f"exists(q, x -> {has_or('x.where_clause')})", msg("DML111.select", w="r.where_clause")), when(has_or("s.update.where_clause"), msg("DML111", w="s.update.where_clause")),
        when(has_or("s.delete.where_clause"), msg("DML111", w="s.delete.where_clause")),
    ),
)
CORE = tuple(_CORE)

# --- the GaussDB pack: all off by default ----------------------------------------------------------------------------------
_GAUSS: list[Rule] = []


def _gauss(id: str, name: str, group: str, severity: str, applies: str, kinds: str, hits: str, **params) -> None:
    level = "file" if kinds == "file" else "statement"
    _GAUSS.append(Rule(f"gaussdb:{id}", f"gaussdb_{name}", f"gaussdb-{group}", severity, False, tuple(applies.split()), level, hits, params, kinds=() if level == "file" else tuple(kinds.split())))


_ALL_NAMES = " ".join(_NAMED)
_gauss("GNAM001", "object_name_charset", "naming", "error", "ddl", _ALL_NAMES, names("GNAM001", lambda x: f"(not {I.is_valid(I.strip_quotes(x))})"))
_QUOTED_TARGET = when(I.is_quoted("s.create_index.table_name"), msg("GNAM002.target", n="s.create_index.table_name"))
_gauss("GNAM002", "no_quoted_object_name", "naming", "error", "ddl", _ALL_NAMES, concat(names("GNAM002", I.is_quoted), _QUOTED_TARGET))
_gauss("GNAM003", "no_reserved_prefix", "naming", "error", "ddl", _ALL_NAMES, names("GNAM003", I.has_reserved_prefix))
_gauss("GNAM004", "object_name_max_bytes", "naming", "error", "ddl", _ALL_NAMES, names("GNAM004", lambda x: f"(octet_length({x}) > {{name_max_bytes}})", "name_max_bytes"), name_max_bytes=63)
_COLUMNS = "coalesce(s.create_table.columns, array())"
_BIG_TYPE = "(upper(c.data_type) rlike 'TEXT|CLOB|BLOB|BYTEA|RAW|JSON|XML|GEOMETRY' or coalesce(try_cast(regexp_extract(c.data_type, '[(] *([0-9]+)', 1) as int), 0) > 2000)"
_gauss("GTYP001", "max_large_fields", "type", "warning", "ddl", "CREATE_TABLE", let("big", each(_COLUMNS, "c", _BIG_TYPE, "c.name"), when("size(big) > {max_large_fields}", msg("GTYP001", "max_large_fields", t=_T, n="size(big)", b=_listed("big")))), max_large_fields=8)
# fixed values
SYSTEM_COLUMNS = ["CTID", "CID", "OID", "XID", "TID", "XMIN", "CMIN", "XMAX", "CMAX"]
RECOMMENDED_TYPES = [
    "TINYINT", "SMALLINT", "INTEGER", "BIGINT", "INT", "INT2", "INT4", "INT8", "NUMERIC", "DECIMAL", "BOOLEAN", "BOOL", "CHAR", "NCHAR", "VARCHAR", "NVARCHAR2", "VARCHAR2", "TEXT",
    "DATE", "TIME", "TIMESTAMP", "TIMESTAMPTZ", "SMALLDATETIME", "INTERVAL", "REALTIME", "BYTEA",
]
_one_of = lambda x, values: f"{x} in ({', '.join(text(v) for v in values)})"
_gauss("GTYP002", "no_system_column", "type", "error", "ddl", "CREATE_TABLE", each(_COLUMNS, "c", _one_of(f"upper({I.strip_quotes('c.name')})", SYSTEM_COLUMNS), hit(msg("GTYP002", n="c.name", t=_T))))
_BASE = "upper(split(c.data_type, '[(]')[0])"
_gauss("GTYP003", "recommended_data_types", "type", "warning", "ddl", "CREATE_TABLE", each(_COLUMNS, "c", f"{_BASE} <> '' and not {_one_of(_BASE, RECOMMENDED_TYPES)}", hit(msg("GTYP003", n="c.name", d="c.data_type"))))
_gauss("GOBJ001", "no_materialized_view", "object", "error", "ddl", "CREATE_VIEW", when("s.view.materialized", msg("GOBJ001", n=_V)))
_gauss("GOBJ002", "no_order_by_in_view", "object", "error", "ddl", "CREATE_VIEW", when("s.view.has_order_by", msg("GOBJ002", n=_V)))
_gauss("GOBJ003", "view_usage_warning", "object", "warning", "ddl", "CREATE_VIEW", when("not s.view.materialized", msg("GOBJ003", n=_V)))
_gauss("GIDX001", "create_index_concurrently", "index", "error", "ddl", "CREATE_INDEX", when("not s.create_index.concurrently", msg("GIDX001", n=_I, t="s.create_index.table_name")))
_gauss("GDCL001", "no_quoted_column_in_ddl", "ddl", "error", "ddl", "ALTER_TABLE", when("s.stmt_text rlike '[\"`]'", msg("GDCL001")))
_TX = "filter(transform(statements, (s, i) -> named_struct('kind', s.kind, 'i', i, 'line', s.line, 'col', s.`column`)), t -> t.kind in ('START_TRANSACTION', 'COMMIT', 'ROLLBACK'))"
_IS_DDL = "(u.kind in ('CREATE_TABLE', 'CREATE_INDEX', 'CREATE_VIEW', 'ALTER_TABLE', 'TRUNCATE') or startswith(u.kind, 'DROP_'))"
_gauss(
    "GDDL001", "require_commit_in_transaction", "ddl", "error", "ddl", "file",
    let("last", f"try_element_at({_TX}, -1)", when(f"last.kind = 'START_TRANSACTION' and exists(filter(statements, (u, i) -> i > last.i), u -> {_IS_DDL})", msg("GDDL001"), "last.line", "last.col")),
)
for _id, _field in (("GDML002", "update"), ("GDML003", "delete")):
    _own = f"s.{_field}"
    _gauss(
        _id, f"no_order_by_group_by_in_{_field}", "dml", "error", "dml", _field.upper(),
        concat(when(f"{_own}.has_order_by", msg(f"{_id}.order", t=f"{_own}.table_name")), when(f"{_own}.has_group_by", msg(f"{_id}.group", t=f"{_own}.table_name"))),
    )
_gauss("GDML004", "update_subquery_to_join", "dml", "warning", "dml", "UPDATE", when("s.update.has_subquery", msg("GDML004", t="s.update.table_name")))


def _sorted(condition: str, key: str) -> str:
    return f"flatten(transform(filter(q, x -> exists(x.order_by, o -> {condition})), x -> array_repeat({hit(msg(key, o='x.order_by_text'))}, cast(x.multiplicity as int))))"


_gauss("GDML005", "order_by_explicit_sort", "dml", "error", "dml", "SELECT", concat(_sorted("o.asc is null", "GDML005.sort"), _sorted("o.nulls_first is null", "GDML005.nulls")))
_LONG = "octet_length(s.stmt_text)"
_gauss("GPERF001", "statement_max_bytes", "performance", "warning", "ddl dml", "", when(f"{_LONG} > {{stmt_max_bytes}}", msg("GPERF001", "stmt_max_bytes", b=_LONG)), stmt_max_bytes=5120)
GAUSS = tuple(_GAUSS)
ALL = CORE + GAUSS
BY_ID = {r.id: r for r in ALL}


# --- rules of a user -----------------------------------------------------------------------------------------------------------
def user_rule(spark, id: str, script: str, name: str = "", group: str | None = None, severity: str = "warning", enabled: bool = True, applies_to: tuple[str, ...] = ("ddl", "dml"), level: str = "statement", kinds: tuple[str, ...] = (), params: dict[str, int] | None = None) -> Rule:
    """A rule whose expression is the text of a file. A missing file, or an expression that does not give hits, becomes a finding
    on every file that the rule applies to, and the other rules run."""
    rule = Rule(id, name or id, group or "", severity, enabled, tuple(applies_to), level, NONE, params or {}, kinds=tuple(kinds))
    path = Path(script)
    if not path.is_file():
        return replace(rule, problem=f"Rule script not found: {path}")
    rule = replace(rule, hits=path.read_text(encoding="utf-8").strip())
    problem = _problem(spark, rule)
    return replace(rule, problem=f"Rule execution error: {problem}") if problem else rule


def _problem(spark, rule: Rule) -> str:
    """Why the expression cannot be analysed over the parse result, or nothing."""
    from pyspark.errors import AnalysisException, ParseException

    from plumbline import schemas

    empty = spark.createDataFrame([], f"script_type string, text string, ast {schemas.AST}").selectExpr("text", "ast.statements statements", "ast.comments comments", "get(ast.statements, 0) s")
    empty = empty.selectExpr("*", "get(s.selects, 0) r", "s.selects q")
    try:
        empty.selectExpr(rule.expression())
        empty.selectExpr(f"transform({rule.expression()}, h -> named_struct('m', cast(h.message as string), 'l', cast(h.line as bigint), 'c', cast(h.`column` as bigint))) hits").schema  # noqa: B018
    except (AnalysisException, ParseException) as e:
        return str(e).strip().split("\n")[0]
    return ""
