"""XML mapper files: dynamic SQL trees, renderings, variants and includes.

Trees are recursive, so they live inside one Arrow UDF; its result is a flat table. Fragments of other files come from a first
pass over the files and are looked up by name in a second.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import xml.parsers.expat
from collections.abc import Iterator
from xml.sax import saxutils

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, _parse_datatype_string

from plumbline import schemas
from plumbline.functions.lexer import normalize_placeholders, repair_artifacts
from plumbline.operators.parse import spread
from plumbline.plans.parser import parse
from plumbline.sources import files as files_

STATEMENTS = ("select", "insert", "update", "delete")
MAX_IFS, INCLUDE_DEPTH, PROBE_BYTES = 8, 10, 50_000
#: Examples of a failure's category, and parts of it that are ordered apart.
EXAMPLES, EXAMPLE_PARTS = 3, 64


class Node:
    __slots__ = ("attrs", "kids", "line", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str], line: int, text: str = ""):
        self.tag, self.attrs, self.line, self.text = tag, attrs, line, text
        self.kids: list[Node] = []


def read_tree(xml_text: str) -> Node:
    """The document as nodes; text is a node with tag ''. Entity declarations are refused."""
    p = xml.parsers.expat.ParserCreate()
    root = Node("#root", {}, 1)
    stack = [root]

    def start(tag, attrs):
        n = Node(tag, attrs, p.CurrentLineNumber)
        stack[-1].kids.append(n)
        stack.append(n)

    def text(data):
        kids = stack[-1].kids
        if kids and kids[-1].tag == "":
            kids[-1].text += data
        else:
            kids.append(Node("", {}, p.CurrentLineNumber, data))

    def refuse(*_):
        raise ValueError("entity declarations are not allowed")

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.EntityDeclHandler = start, lambda _: stack.pop(), text, refuse
    p.Parse(xml_text, True)
    return root


def find_all(node: Node, tags: tuple[str, ...]) -> Iterator[Node]:
    for k in node.kids:
        if k.tag in tags:
            yield k
        else:
            yield from find_all(k, tags)


def fragments_of(root: Node) -> dict[str, Node]:
    """`namespace.id` of every <sql>."""
    out = {}
    for mapper in find_all(root, ("mapper", "sqlMap")):
        ns = mapper.attrs.get("namespace", "")
        for f in find_all(mapper, ("sql",)):
            out[f"{ns}.{f.attrs.get('id', '')}" if ns else f.attrs.get("id", "")] = f
    return out


def inline(nodes: list[Node], namespace: str, fragments: dict[str, Node], depth: int = 0) -> list[Node]:
    """Replace <include> by the fragment's content: the own namespace first, then the full name."""
    out = []
    for n in nodes:
        if n.tag == "selectKey":
            continue
        if n.tag == "include":
            ref = n.attrs.get("refid", "")
            found = fragments.get(f"{namespace}.{ref}") or fragments.get(ref)
            if found is None:
                out.append(Node("", {}, n.line, f"/* missing include: {ref} */"))
            elif depth >= INCLUDE_DEPTH:
                out += found.kids
            else:
                props = {k.attrs.get("name", ""): k.attrs.get("value", "") for k in n.kids if k.tag == "property"}
                for kid in inline(found.kids, namespace, fragments, depth + 1):
                    if kid.tag == "" and props:
                        kid = Node("", {}, kid.line, re.sub(r"\$\{(\w+)\}", lambda m: props.get(m[1], m[0]), kid.text))
                    out.append(kid)
        else:
            copy = Node(n.tag, n.attrs, n.line, n.text)
            copy.kids = inline(n.kids, namespace, fragments, depth)
            out.append(copy)
    return out


def _join(parts: list[str]) -> str:
    return " ".join(p.strip() for p in parts if p.strip())


def trim_clause(body: str, prefix: str, suffix: str, drop_first: list[str], drop_last: list[str]) -> str:
    """<trim>: strip overrides at either end, then add prefix and suffix; nothing stays nothing."""
    body = body.strip()
    if not body:
        return ""
    for word in drop_first:
        w = word.strip()
        if w and body.upper().startswith(w.upper()) and (not w[-1].isalnum() or not body[len(w) : len(w) + 1].isalnum()):
            body = body[len(w) :].lstrip()
            break
    for word in drop_last:
        w = word.strip()
        if w and body.upper().endswith(w.upper()) and (not w[0].isalnum() or not body[-len(w) - 1 : -len(w)].isalnum()):
            body = body[: -len(w)].rstrip()
            break
    return " ".join(x for x in (prefix.strip(), body, suffix.strip()) if x) if body else ""


def _wrap(n: Node, body: str) -> str:
    if n.tag == "where":
        return trim_clause(body, "WHERE", "", ["AND", "OR"], [])
    if n.tag == "set":
        return trim_clause(body, "SET", "", [], [","])
    a = n.attrs
    return trim_clause(body, a.get("prefix", ""), a.get("suffix", ""), a.get("prefixOverrides", "").split("|"), a.get("suffixOverrides", "").split("|"))


def _foreach(n: Node, body: str, times: int) -> str:
    if not times:
        return ""
    return n.attrs.get("open", "") + n.attrs.get("separator", ",").join([body.strip()] * times) + n.attrs.get("close", "")


def count_ifs(nodes: list[Node]) -> int:
    return sum((n.tag == "if") + count_ifs(n.kids) for n in nodes)


def render(nodes: list[Node], mode: str, depth: int = 0) -> str:
    """`all`: every if holds; `exclusive`: ifs below another if do not; `first`: choose and ifs take the first branch only."""
    out, taken = [], False
    for n in nodes:
        if n.tag == "":
            out.append(n.text)
        elif n.tag == "if":
            if mode == "exclusive" and depth or mode == "first" and taken:
                continue
            taken = True
            out.append(render(n.kids, mode, depth + 1))
        elif n.tag == "choose":
            branch = next((k for k in n.kids if k.tag == "when"), None) or next((k for k in n.kids if k.tag == "otherwise"), None)
            out.append(render(branch.kids, mode, depth) if branch else "")
        elif n.tag == "foreach":
            out.append(_foreach(n, render(n.kids, mode, depth), 1))
        elif n.tag in ("where", "set", "trim"):
            out.append(_wrap(n, render(n.kids, mode, depth)))
        elif n.tag != "bind":
            out.append(render(n.kids, mode, depth))
    return _join(out)


def _choices(nodes: list[Node]) -> list[list[tuple[str, str]]]:
    """For each part of a sequence its possible (text, label)."""
    out: list[list[tuple[str, str]]] = []
    for n in nodes:
        if n.tag == "":
            out.append([(n.text, "")])
        elif n.tag == "if":
            out.append([(t, _label(f"if({n.attrs.get('test', '')})=true", lab)) for t, lab in _expand(n.kids)] + [("", f"if({n.attrs.get('test', '')})=false")])
        elif n.tag == "choose":
            branches = [(k, f"when({k.attrs.get('test', '')})" if k.tag == "when" else "otherwise") for k in n.kids if k.tag in ("when", "otherwise")]
            out.append([(t, _label(name, lab)) for k, name in branches for t, lab in _expand(k.kids)] or [("", "")])
        elif n.tag == "foreach":
            out.append([(_foreach(n, t, k), _label(f"foreach={k}", lab)) for k in (1, 0, 3) for t, lab in _expand(n.kids)])
        elif n.tag in ("where", "set", "trim"):
            out.append([(_wrap(n, t), lab) for t, lab in _expand(n.kids)])
        elif n.tag != "bind":
            out.append(_expand(n.kids))
    return out


def _label(*parts: str) -> str:
    return "; ".join(p for p in parts if p)


def _expand(nodes: list[Node]) -> list[tuple[str, str]]:
    return [(_join([t for t, _ in combo]), _label(*[lab for _, lab in combo])) for combo in itertools.product(*_choices(nodes))]


def variants(nodes: list[Node], max_ifs: int = MAX_IFS) -> list[dict[str, str]]:
    """All combinations of branches up to `max_ifs` conditions; above that the baseline and one variant for each condition.

    Variants that differ only in case and white space are one; blank ones are all kept.
    """
    if count_ifs(nodes) <= max_ifs:
        found = _expand(nodes)
    else:
        found = [(render(nodes, "none"), "baseline")]
        tests: list[Node] = []

        def gather(ns: list[Node]) -> None:
            for n in ns:
                if n.tag == "if":
                    tests.append(n)
                gather(n.kids)

        gather(nodes)
        found = [(_only(nodes, None), "baseline")] + [(_only(nodes, t), f"if({t.attrs.get('test', '')})=true") for t in tests]
    seen, out = set(), []
    for sql, label in found:
        sql = normalize_placeholders(sql)
        key = " ".join(sql.lower().split())
        if key and key in seen:
            continue
        seen.add(key)
        out.append({"sql": sql, "label": label})
    return out


def _only(nodes: list[Node], one: Node | None) -> str:
    """Rendering in which just one if (and those around it) holds."""

    def holds(n: Node) -> bool:
        return one is not None and (n is one or any(holds(k) for k in n.kids))

    def walk(ns: list[Node]) -> str:
        out = []
        for n in ns:
            if n.tag == "":
                out.append(n.text)
            elif n.tag == "if":
                out.append(walk(n.kids) if holds(n) else "")
            elif n.tag == "choose":
                branch = next((k for k in n.kids if k.tag in ("when", "otherwise") and holds(k)), None) or next((k for k in n.kids if k.tag in ("when", "otherwise")), None)
                out.append(walk(branch.kids) if branch else "")
            elif n.tag == "foreach":
                out.append(_foreach(n, walk(n.kids), 1))
            elif n.tag in ("where", "set", "trim"):
                out.append(_wrap(n, walk(n.kids)))
            elif n.tag != "bind":
                out.append(walk(n.kids))
        return _join(out)

    return walk(nodes)


def _raw(nodes: list[Node]) -> str:
    return "".join(n.text if n.tag == "" else _raw(n.kids) for n in nodes)


def is_clean(sql: str) -> bool:
    ast = parse(sql)
    return not ast["parse_error"] and bool(ast["statements"]) and all(s["kind"] != "PARSE_ERROR" for s in ast["statements"])


def pick(candidates: list[str]) -> str:
    """The first rendering that parses; long ones are not tried; else the first, with stray commas repaired."""
    for sql in candidates:
        if len(sql.encode()) <= PROBE_BYTES and is_clean(sql):
            return sql
    return repair_artifacts(candidates[0])


def extract(xml_text: str, shared: dict[str, Node] | None = None) -> list[dict]:
    root = read_tree(xml_text)
    fragments = {**(shared or {}), **fragments_of(root)}
    out = []
    for mapper in find_all(root, ("mapper", "sqlMap")):
        ns = mapper.attrs.get("namespace", "")
        for st in find_all(mapper, STATEMENTS):
            nodes = inline(st.kids, ns, fragments)
            raw = _raw(nodes)
            render_ = lambda mode, nodes=nodes: normalize_placeholders(render(nodes, mode))
            dynamic = any(n.tag for n in nodes)
            out.append({
                "statement_id": f"{ns}.{st.attrs.get('id', '')}" if ns else st.attrs.get("id", ""), "statement_type": st.tag, "raw_xml_line": st.line, "raw_sql": raw.strip(),
                "sql_all": render_("all"), "sql_exclusive": render_("exclusive"), "sql_first": render_("first"), "has_dynamic": dynamic, "has_dollar": "${" in raw, "n_ifs": count_ifs(nodes), "variants": variants(nodes),
            })
    return out


_GIVEN = "array<struct<name:string,xml:string>>"


def _to_xml(n: Node) -> str:
    if n.tag == "":
        return saxutils.escape(n.text)
    attrs = "".join(f" {k}={saxutils.quoteattr(v)}" for k, v in n.attrs.items())
    return f"<{n.tag}{attrs}>{''.join(map(_to_xml, n.kids))}</{n.tag}>"


def fragments(files: DataFrame) -> DataFrame:
    """(name, xml, needs) of every <sql> element; needs: what it includes itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, xmls = [], []
            for text in batch.column("text").to_pylist():
                try:
                    found = fragments_of(read_tree(text or ""))
                except (xml.parsers.expat.ExpatError, ValueError):
                    continue
                names += found
                xmls += map(_to_xml, found.values())
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(xmls, pa.string())], ["name", "xml"])

    out = files.where(F.contains("text", F.lit("<sql"))).select("text").mapInArrow(run, "name string, xml string")
    return out.withColumn("needs", _refs("xml")).dropDuplicates(["name"])


def _refs(column: str):
    return F.array_distinct(F.regexp_extract_all(column, F.lit(r"<include[^>]*refid\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)))


def _extract(files: DataFrame) -> DataFrame:
    """files (file_path, text, given) -> statements."""
    kind = _parse_datatype_string(schemas.MAPPER_SQL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for batch in batches:
            rows = []
            for path, text, given in zip(*(batch.column(c).to_pylist() for c in ("file_path", "text", "given")), strict=True):
                try:
                    shared = {g["name"]: read_tree(g["xml"]).kids[0] for g in given or []}
                    rows += [{"file_path": path} | r for r in extract(text or "", shared)]
                except (xml.parsers.expat.ExpatError, ValueError):
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("file_path", "text", "given").mapInArrow(run, kind)


def mapper_sql(files: DataFrame, across_files: bool = True) -> DataFrame:
    """files (file_path, text of an XML mapper) -> one row a statement. Files that are no XML give no rows.

    A file whose includes are all its own is read in one pass. Only files that name fragments of others are joined with the
    table of fragments (by name, and again for what those fragments include).
    """
    none = F.lit(None).cast(_GIVEN)
    namespace = F.regexp_extract("text", r"<(?:mapper|sqlMap)[^>]*namespace\s*=\s*[\"']([^\"']*)[\"']", 1)
    own = F.regexp_extract_all("text", F.lit(r"<sql[^>]*\bid\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    rows = spread(files.select("file_path", "text")).withColumn("needs", F.array_except(_refs("text"), F.concat(own, F.transform(own, lambda i: F.concat(namespace, F.lit("."), i)))))
    alone = rows if not across_files else rows.where(F.size("needs") == 0)
    result = _extract(alone.withColumn("given", none))
    if not across_files:
        return result
    table = fragments(files)
    asked = rows.where(F.size("needs") > 0).select("file_path", F.explode("needs").alias("name"))
    have = None
    for _ in range(INCLUDE_DEPTH):
        found = asked.join(table, "name").select("file_path", "name", "xml", "needs")
        have = found if have is None else have.unionByName(found)
        asked = found.select("file_path", F.explode("needs").alias("name")).join(have.select("file_path", "name"), ["file_path", "name"], "left_anti").distinct()
        if not asked.limit(1).count():
            break
    given = have.groupBy("file_path").agg(F.collect_list(F.struct("name", "xml")).alias("given"))  # the includes of one file
    return result.unionByName(_extract(rows.where(F.size("needs") > 0).join(given, "file_path", "left")))


@F.pandas_udf(StringType())
def pick_candidate(a, b, c):
    """Column form of `pick` over the three renderings."""
    import pandas as pd

    return pd.Series([pick([x or "", y or "", z or ""]) for x, y, z in zip(a, b, c, strict=True)])


def as_scripts(statements: DataFrame, type_map: dict[str, str] | None = None, default: str = "dml") -> DataFrame:
    """Mapper statements as scripts with a line offset, so that rules report lines of the XML file."""
    kinds = F.create_map(*[F.lit(x) for kv in (type_map or {}).items() for x in kv]) if type_map else None
    script_type = F.coalesce(kinds[F.col("statement_type")], F.lit(default)) if kinds is not None else F.lit(default)
    return statements.select("file_path", script_type.alias("script_type"), pick_candidate("sql_all", "sql_exclusive", "sql_first").alias("text"), (F.col("raw_xml_line") - 1).alias("line_offset"), "statement_id", "has_dollar")


def failures(statements: DataFrame) -> DataFrame:
    """Why statements do not parse: (category, n, examples)."""
    from plumbline.operators.parse import parse_scripts

    asts = parse_scripts(as_scripts(statements))
    bad = asts.where("ast.parse_error is not null or exists(ast.statements, s -> s.kind = 'PARSE_ERROR') or size(ast.statements) = 0")
    category = (
        F.when(F.col("ast.parse_error").isNotNull(), "tokenize").when(F.trim("text") == "", "empty").when(F.contains("text", F.lit("missing include")), "missing include")
        .when(F.col("has_dollar"), "dynamic substitution").when(F.col("text").rlike(r"(?i)\bCALL\b|\{\s*call"), "procedure call").otherwise("syntax")
    )
    found = bad.select(category.alias("category"), F.concat_ws("#", "file_path", "statement_id").alias("id"))
    counts = found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    # the first three ids of a category, kept per task before they meet
    nth = F.row_number().over(Window.partitionBy("category", "part").orderBy("id"))
    parts = found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(EXAMPLE_PARTS))).withColumn("nth", nth).where(F.col("nth") <= EXAMPLES)
    first = parts.groupBy("category").agg(F.array_join(F.slice(F.array_sort(F.collect_list("id")), 1, EXAMPLES), ", ").alias("examples"))
    return counts.join(first, "category").select("category", "n", "examples")


def _prefixes(path) -> Column:
    """The folders above a path, from the outermost."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda k: F.array_join(F.slice(parts, 1, k + 1), "/"))
    return F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))


def scan(spark: SparkSession, root: str, paths: tuple[str, ...] = (".",), patterns: tuple[str, ...] = ("**/*Mapper.xml", "**/*.xml"), exclude_dirs: tuple[str, ...] = files_.EXCLUDED) -> DataFrame:
    """file_path, content, mtime, size, entry: mapper files below `root` that an entry of `paths` names.

    An entry is a folder (relative to root, or absolute), whose XML files count where a pattern fits their path inside it, or a glob over
    paths inside root: of a folder that it fits the same holds, and an XML file that it fits counts itself. A file that several
    entries name is there once, with the first of them as `entry`.
    """
    glob = lambda g: files_.glob_regex(g, within_name=False).replace("(?:^|/)", "^", 1)
    fits = lambda inside: functools.reduce(lambda a, b: a | b, [inside.rlike(glob(p)) for p in patterns])
    base = os.path.abspath(root) if "://" not in root else root.rstrip("/")
    plain = lambda c: F.regexp_replace(c, r"^file:(//)?", "")
    found = None
    for k, entry in enumerate(paths):
        folder = entry if os.path.isabs(entry) or any(c in entry for c in "*?[{") else base if entry in (".", "") else f"{base}/{entry.strip('/')}"
        is_glob = any(c in entry for c in "*?[{")
        start = base if is_glob else folder.rstrip("/")
        if not is_glob and "://" not in start and not os.path.exists(start):
            continue
        files = files_.scan(spark, start, r"\.xml$", ())
        inside = F.substring(plain(F.col("file_path")), len(start) + 2, 1 << 20)
        files = files.withColumn("inside", inside)
        if exclude_dirs:
            files = files.where(~F.arrays_overlap(_names(F.col("inside")), F.array(*[F.lit(d) for d in exclude_dirs])))
        if is_glob:
            whole = glob(entry)
            below = F.exists(_prefixes(F.col("inside")), lambda d: d.rlike(whole) & fits(F.substring(F.col("inside"), F.length(d) + 2, F.lit(1 << 20))))
            files = files.where(F.col("inside").rlike(whole) | below)
        else:
            files = files.where(fits(F.col("inside")))
        named = files.drop("inside").withColumn("entry", F.lit(k))
        found = named if found is None else found.unionByName(named)
    if found is None:
        return spark.createDataFrame([], "file_path string, content binary, mtime timestamp, size long, entry int")
    first = found.groupBy("file_path").agg(F.min("entry").alias("entry"))
    return found.join(first, ["file_path", "entry"], "left_semi")


def _names(path) -> Column:
    """Folder names of a path."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
