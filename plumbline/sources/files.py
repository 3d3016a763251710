"""File sources: scanning, decoding, classification, byte-level checks and directory checks."""

from __future__ import annotations

import codecs
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

SQL_FILE = r"(?i)\.(sql|ddl|dml)$"
EXCLUDED = (".git", "target", "node_modules", "vendor")


def glob_regex(glob: str, within_name: bool = True) -> str:
    """`**/` any folders, `*` and `?` (within a name, or over slashes too), `{a,b}` and `[..]`; anchored to a path or to its end after a slash."""
    out, i = "", 0
    one = "[^/]" if within_name else "."
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += {"*": one + "*", "?": one, "{": "(?:", "}": ")", ",": "|" if "{" in glob[:i] and "}" in glob[i:] else ","}.get(c, c if c in "[]" else re.escape(c))
        i += 1
    return f"(?:^|/){out}$"


def scan(spark: SparkSession, root: str, pattern: str = SQL_FILE, exclude_dirs: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """file_path, content, mtime, size of matching files below `root`, skipping excluded folder names at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.col("path")
    kept = files.where(path.rlike(pattern))
    if exclude_dirs:
        kept = kept.where(~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in exclude_dirs])))
    return kept.select(path.alias("file_path"), "content", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def validate_encoding(label: str) -> str:
    """The codec's name; ValueError if it is unknown."""
    try:
        return codecs.lookup(label).name
    except LookupError as e:
        raise ValueError(f"unknown encoding {label!r}") from e


def _decode_one(raw: bytes, label: str) -> str | None:
    for mark, name in ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw.startswith(mark):
            label = name
            break
    try:
        return raw.decode(label)
    except UnicodeDecodeError:
        return None


def decode(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """files with `text`: strict, null where the bytes do not decode. UTF-8 stays in the JVM unless a byte order mark says otherwise."""
    name = validate_encoding(encoding)
    if name == "utf-8":
        head = F.hex(F.substring(F.col("content"), 1, 3))
        body = F.when(head == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content"))
        marked = F.expr("substring(hex(substring(content, 1, 4)), 1, 4) in ('FFFE', 'FEFF') or hex(substring(content, 1, 4)) in ('FFFE0000', '0000FEFF')")
        plain = files.where(~marked).withColumn("text", F.try_validate_utf8(body.cast("string")))
        return plain.unionByName(_decode_python(files.where(marked), name))
    return _decode_python(files, name)


def _decode_python(files: DataFrame, label: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [None if raw is None else _decode_one(raw, label) for raw in batch.column("content").to_pylist()]
            yield pa.record_batch([*(batch.column(i) for i in range(batch.num_columns)), pa.array(out, pa.string())], [*batch.schema.names, "text"])

    return files.mapInArrow(run, StructType([*files.schema.fields]).add("text", StringType()))


def classify(path: Column, rules: list[tuple[str, str, int]], default: str = "sql") -> Column:
    """script type: of rules (glob, type, priority) the first match by falling priority, else the default."""
    out = F.lit(default)
    for glob, kind, _ in reversed(sorted(rules, key=lambda r: -r[2])):
        out = F.when(path.rlike(glob_regex(glob)), F.lit(kind)).otherwise(out)
    return out


def scripts(spark: SparkSession, root: str, rules: list[tuple[str, str, int]], default: str = "sql", encoding: str = "utf-8") -> DataFrame:
    """Scan, decode and classify: file_path, script_type, text."""
    files = decode(scan(spark, root), encoding)
    return files.select("file_path", classify(F.col("file_path"), rules, default).alias("script_type"), "text")


_MARKS = [("EFBBBF", "File must be UTF-8 without BOM, but a UTF-8 BOM (EF BB BF) was found at the start of the file. Remove the BOM.")] + [
    (mark, f"File must be UTF-8 without BOM, but a {name} BOM was found. Re-encode the file as UTF-8.")
    for mark, name in (("FFFE0000", "UTF-32 LE"), ("0000FEFF", "UTF-32 BE"), ("FFFE", "UTF-16 LE"), ("FEFF", "UTF-16 BE"))
]


@F.pandas_udf(LongType())
def invalid_offset(content):
    """Offset of the first byte that is not valid UTF-8."""

    def one(raw):
        try:
            if raw is not None:
                raw.decode("utf-8")
        except UnicodeDecodeError as e:
            return e.start
        return None

    return content.map(one).astype("Int64")


def encoding_issue(content: Column) -> Column:
    """The message of FILE001, or null. Python runs only on rows that are known to be invalid."""
    head = F.hex(F.substring(content, 1, 4))
    bad = F.concat(F.lit("File is not valid UTF-8: invalid byte sequence at offset "), invalid_offset(F.when(~F.is_valid_utf8(content.cast("string")), content)).cast("string"), F.lit(". Re-encode the file as UTF-8 (no BOM)."))
    out = F.when(~F.is_valid_utf8(content.cast("string")), bad)
    for mark, message in reversed(_MARKS):
        out = F.when(F.startswith(head, F.lit(mark)), F.lit(message)).otherwise(out)
    return out


def line_ending_issue(text: str) -> dict[str, str]:
    """SQL expressions of FILE002 over a text expression: counts, first line and message."""
    crlf = f"(length({text}) - length(replace({text}, '\\r\\n', '\\n')))"
    cr = f"(length({text}) - length(replace({text}, '\\r', '')) - {crlf})"
    first = f"(length(regexp_replace(substring_index({text}, '\\r', 1), '[^\\n]', '')) + 1)"
    kind = f"case when {crlf} > 0 and {cr} > 0 then concat('mixed CRLF (', {crlf}, ') and lone CR (', {cr}, ') line endings') when {crlf} > 0 then concat('CRLF line endings (', {crlf}, ' line(s))') else concat('lone CR line endings (', {cr}, ' line(s))') end"
    message = f"concat('Line endings should be LF (\\\\n), but ', {kind}, ' were found; first at line ', {first}, '. Convert line endings to LF.')"
    return {"crlf": crlf, "cr": cr, "first_line": first, "message": message, "has_issue": f"contains({text}, '\\r')"}


def file_checks(files: DataFrame, encoding_severity: str = "error", line_ending_severity: str = "warning", check_encoding: bool = True) -> DataFrame:
    """FILE001 and FILE002 violations of files (file_path, script_type, content)."""
    rows = files.select("file_path", "script_type", "content", F.col("content").cast("string").alias("text"))
    e = line_ending_issue("text")
    row = lambda i, n, sev, m, line: F.struct(F.lit(i).alias("rule_id"), F.lit(n).alias("rule_name"), F.lit("file").alias("rule_group"), F.lit(sev).alias("severity"), m.alias("message"), line.cast("bigint").alias("line"))
    issue = encoding_issue(F.col("content")) if check_encoding else F.lit(None).cast("string")
    staged = rows.withColumn("issue", issue)
    found = F.array_compact(F.array(
        F.when(F.col("issue").isNotNull(), row("FILE001", "file_encoding", encoding_severity, F.col("issue"), F.lit(1))),
        F.when(F.expr(e["has_issue"]), row("FILE002", "line_ending", line_ending_severity, F.expr(e["message"]), F.expr(e["first_line"]))),
    ))
    out = staged.select("file_path", "script_type", F.explode(found).alias("v"))
    null = F.lit(None).cast("bigint")
    return out.select("v.rule_id", "v.rule_name", "v.rule_group", "v.severity", "v.message", "file_path", "script_type", "v.line", null.alias("end_line"), null.alias("column"))


def directory_issues(found: DataFrame, required: DataFrame, allow_extra: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """found (path), required (path) -> (path, issue_type): missing, and in strict mode unexpected folders."""
    need = required.select(F.rtrim(F.col("path"), F.lit("/")).alias("path")).distinct()
    have = found.select(F.rtrim(F.col("path"), F.lit("/")).alias("path")).distinct()
    out = need.join(have, "path", "left_anti").select("path", F.lit("missing").alias("issue_type"))
    if strict:
        extra = have.join(need, "path", "left_anti")
        above = need.select(F.col("path").alias("below"))
        parts = F.transform(F.sequence(F.lit(1), F.size(F.split("below", "/"))), lambda k: F.array_join(F.slice(F.split("below", "/"), 1, k), "/"))
        parents = above.select(F.explode(parts).alias("path")).distinct()
        extra = extra.join(parents, "path", "left_anti")
        for a in allow_extra:
            extra = extra.where(~(F.startswith(F.col("path"), F.lit(a)) | (F.col("path") == a.rstrip("/"))) if a.endswith("/") else F.col("path") != a)
        out = out.unionByName(extra.select("path", F.lit("unexpected").alias("issue_type")))
    return out
