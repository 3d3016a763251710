"""Running rules: filter, one projection over all of them, exemptions, end lines, and hunks.

From the parse on, a run is a map: rules are expressions on a file's row, exemptions are looked up in the file's own comment
lines, and nothing is shuffled. Only the join with diff hunks moves data, and there the hunks are the small side.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.parse import parse_scripts, shuffled
from plumbline.operators.rules import ALL, Rule
from plumbline.operators.rules import text as quote

VIOLATION = "struct<rule_id:string,rule_name:string,rule_group:string,severity:string,message:string,line:bigint,column:bigint>"


@dataclass(frozen=True)
class RuleFilter:
    """Exclusion wins; included ids and groups must both hold where given. `*` at the end is a prefix; `ns:x` names a namespace."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include_groups: tuple[str, ...] = ()
    exclude_groups: tuple[str, ...] = ()

    @staticmethod
    def _one(pattern: str, rule_id: str) -> bool:
        ns, _, short = rule_id.rpartition(":")
        if ":" in pattern:
            want, _, pattern = pattern.partition(":")
            if want.lower() != ns.lower():
                return False
        pattern, short = pattern.upper(), short.upper()
        return short.startswith(pattern[:-1]) if pattern.endswith("*") else short == pattern

    def matches(self, rule_id: str, group: str | None) -> bool:
        if any(self._one(p, rule_id) for p in self.exclude) or group in self.exclude_groups:
            return False
        if self.include and not any(self._one(p, rule_id) for p in self.include):
            return False
        return not self.include_groups or group in self.include_groups


def select_rules(rules: Iterable[Rule] = ALL, only: RuleFilter = RuleFilter(), all_enabled: bool = False) -> list[Rule]:
    return [r for r in rules if (r.enabled or all_enabled) and only.matches(r.id, r.group)]


def _labelled(rule: Rule, expression: str) -> str:
    constants = ", ".join(f"'{k}', {quote(v)}" for k, v in (("rule_id", rule.id), ("rule_name", rule.name), ("rule_group", rule.group), ("severity", rule.severity)))
    applies = ", ".join(map(quote, rule.applies_to))
    return f"case when script_type in ({applies}) then transform({expression}, h -> named_struct({constants}, 'message', h.message, 'line', h.line, 'column', h.`column`)) else {EMPTY} end"


EMPTY = f"cast(array() as array<{VIOLATION}>)"


def _combined(parts: list[str]) -> str:
    return f"concat({', '.join(parts)})" if parts else EMPTY


def _by_kind(rules: list[Rule]) -> str:
    """Hits of one statement: only the rules for its kind are evaluated."""
    kinds = dict.fromkeys(k for r in rules for k in r.kinds)
    own = lambda k: _combined([_labelled(r, r.expression()) for r in rules if not r.kinds or k in r.kinds])
    branches = " ".join(f"when {quote(k)} then {own(k)}" for k in kinds)
    return f"case s.kind {branches} else {own('')} end" if branches else own("")


def exemptions(marker: str = "lint") -> str:
    """array<struct<line, ids>> of `-- lint-disable-next-line IDS`, `-- lint-disable-line IDS` and `/* lint-disable IDS */`."""
    form = lambda l: f"regexp_extract({l}, '(?i){marker}-disable(-next-line|-line)?(.*)', 1)"
    rest = lambda l: f"split(regexp_extract({l}, '(?i){marker}-disable(-next-line|-line)?(.*)', 2), '\\\\*/')[0]"
    ids = lambda l: f"transform(filter(split({rest(l)}, '[,\\\\s]+'), x -> x rlike '^[A-Za-z0-9*_-]+$'), x -> upper(x))"
    lines = "filter(transform(split(text, '\\n'), (l, i) -> named_struct('l', l, 'i', i + 1)), x -> contains(lower(x.l), '" + marker.lower() + "-disable'))"
    return f"case when contains(lower(text), '{marker.lower()}-disable') then filter(transform({lines}, x -> named_struct('line', cast(x.i + if(lower({form('x.l')}) = '-next-line', 1, 0) as bigint), 'ids', {ids('x.l')})), e -> size(e.ids) > 0) else cast(array() as array<struct<line:bigint,ids:array<string>>>) end"


_EXEMPT = "exists(exempt, e -> e.line = h.line and exists(e.ids, d -> d = '*' or d = upper(h.rule_id) or (endswith(d, '*') and startswith(upper(h.rule_id), left(d, length(d) - 1)))))"


def violations(asts: DataFrame, rules: Iterable[Rule], dialect: str = "generic", marker: str = "lint", trust_dynamic: bool = False) -> DataFrame:
    """Violations of parsed scripts. An optional column `line_offset` (mapper files) moves all lines."""
    stopped = [r for r in rules if r.problem]
    rules = [r for r in rules if not r.problem]
    file_rules = [_labelled(r, r.expression()) for r in rules if r.level == "file"]
    row_rules = _by_kind([r for r in rules if r.level == "statement"])
    problems = _combined([_labelled(r, f"array(named_struct('message', {quote(r.problem)}, 'line', cast(null as bigint), 'column', cast(null as bigint)))") for r in stopped])
    guard = "concat('SQL parse error: ', ast.parse_error)"
    guarded = [_labelled(r, f"array(named_struct('message', {guard}, 'line', cast(1 as bigint), 'column', cast(null as bigint)))") for r in rules if r.guarded]
    unguarded = [_labelled(r, r.expression()) for r in rules if r.level == "file" and not r.guarded]
    engine = lambda i, n, m, line: f"named_struct('rule_id', '{i}', 'rule_name', '{n}', 'rule_group', 'engine', 'severity', 'warning', 'message', {m}, 'line', cast({line} as bigint), 'column', cast(null as bigint))"
    dynamic = "contains(text, '${')" if trust_dynamic else "false"
    dyn = engine("DYN", "dynamic_unchecked", f"'contains ${{}} runtime substitution ({dialect} dialect); statically unchecked'", "1")
    lexed = engine("PARSE", "parse_error", f"concat('SQL tokenize error with {dialect} dialect: ', ast.parse_error)", "1")
    failed = engine("PARSE", "parse_error", f"concat('SQL parse error with {dialect} dialect at line ', s.line, ' (statement skipped)')", "s.line")
    offset = F.col("line_offset") if "line_offset" in asts.columns else F.lit(0)
    has_failed = "exists(statements, s -> s.kind = 'PARSE_ERROR')"
    rows = asts.select(
        "file_path", "script_type", F.coalesce("text", F.lit("")).alias("text"), "ast", F.col("ast.statements").alias("statements"), F.col("ast.comments").alias("comments"), offset.cast("bigint").alias("line_offset")
    )
    per_file = (
        f"case when ast.parse_error is not null then concat({', '.join([f'array(if({dynamic}, {dyn}, {lexed}))', *guarded, *unguarded])}) "
        f"else concat(if({dynamic} and {has_failed}, array({dyn}), {EMPTY}), {_combined(file_rules)}) end"
    )
    rows = rows.select(
        "file_path", "script_type", "line_offset", F.expr(exemptions(marker)).alias("exempt"), F.expr("transform(statements, s -> named_struct('line', s.line, 'end_line', s.end_line))").alias("spans"),
        F.expr(f"concat({per_file}, {problems})" if stopped else per_file).alias("file_hits"), F.expr(dynamic).alias("is_dynamic"), F.posexplode_outer("statements").alias("pos", "s"),
    )
    rows = rows.select("*", F.expr("if(s.kind = 'SELECT', get(s.selects, 0), null)").alias("r"), F.expr("if(s.kind = 'SELECT', s.selects, null)").alias("q"))
    failed_hit = f"case when s.kind = 'PARSE_ERROR' and not is_dynamic then array({failed}) else {EMPTY} end"
    every = f"concat(if(coalesce(pos, 0) = 0, file_hits, {EMPTY}), case when s is null then {EMPTY} else concat({failed_hit}, {row_rules}) end)"
    kept = f"if(size(exempt) > 0, filter(hits, h -> h.line is null or not {_EXEMPT}), hits)"
    out = rows.select("file_path", "script_type", "line_offset", "spans", "exempt", F.expr(every).alias("hits")).select("file_path", "script_type", "line_offset", "spans", F.explode(F.expr(kept)).alias("h"))
    end = "get(filter(spans, x -> x.line <= h.line and x.end_line >= h.line), 0).end_line"
    return out.select(
        "h.rule_id", "h.rule_name", "h.rule_group", "h.severity", "h.message", "file_path", "script_type", (F.col("h.line") + F.col("line_offset")).alias("line"), (F.expr(end) + F.col("line_offset")).alias("end_line"), F.col("h.column").alias("column")
    )


def check(scripts: DataFrame, rules: Iterable[Rule] | None = None, dialect: str = "generic", fallback: tuple[str, ...] = (), **options) -> DataFrame:
    """scripts (file_path, script_type, text) -> violations."""
    return violations(parse_scripts(scripts, dialect, fallback), select_rules() if rules is None else rules, dialect, **options)


def in_hunks(found: DataFrame, hunks: DataFrame) -> DataFrame:
    """Violations that touch a changed range: the file is new, there is no line range, or a range overlaps a hunk."""
    new_side = hunks.where("side = 'new'")
    files = hunks.groupBy("path").agg(F.max("is_new").alias("is_new"))
    named = shuffled(found).join(files.withColumnRenamed("path", "file_path"), "file_path")
    free = named.where("is_new or line is null or end_line is null").drop("is_new")
    ranged = named.where("not is_new and line is not null and end_line is not null").drop("is_new")
    h = new_side.select(F.col("path").alias("file_path"), "start_line", F.col("end_line").alias("stop_line"))
    on = (ranged["file_path"] == h["file_path"]) & (ranged["line"] <= h["stop_line"]) & (ranged["end_line"] >= h["start_line"])
    return free.unionByName(ranged.join(h, on, "left_semi"))


def exit_status(found: DataFrame, missing_directories: int = 0) -> DataFrame:
    """failed: some violation is an error, or a required directory is missing."""
    return found.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("has_error")).select((F.col("has_error") | F.lit(missing_directories > 0)).alias("failed"))
