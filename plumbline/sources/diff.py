"""Diff text as a table of hunks, and versions of files from git (a driver-side process)."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import schemas

_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def parse_diff(lines: DataFrame) -> DataFrame:
    """lines (diff_id, line_no, line) -> hunks (diff_id, path, side, start_line, end_line, is_new).

    A side of length 0 is absent, a missing length is 1. Header state is carried by windows within one diff.
    """
    line = F.col("line")
    before = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    file_no = F.sum(F.startswith(line, F.lit("diff --git ")).cast("int")).over(before)
    marked = lines.withColumn("file_no", file_no)
    own = Window.partitionBy("diff_id", "file_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(line.rlike(_HEADER)).over(own.rowsBetween(Window.unboundedPreceding, -1))
    head = F.coalesce(~seen, F.lit(True))
    path = F.last(F.when(head & F.startswith(line, F.lit("+++ b/")), F.substring(line, 7, 1 << 20)), True).over(own)
    new = F.max(F.when(head & F.startswith(line, F.lit("new file mode")), F.lit(True))).over(own)
    rows = marked.select("diff_id", "line", path.alias("path"), F.coalesce(new, F.lit(False)).alias("is_new")).where(F.col("line").rlike(_HEADER) & F.col("path").isNotNull())
    number = lambda k: F.regexp_extract("line", _HEADER, k)
    length = lambda k: F.when(number(k) == "", F.lit(1)).otherwise(number(k).cast("bigint"))
    side = lambda name, a, b: F.struct(F.lit(name).alias("side"), number(a).cast("bigint").alias("start"), length(b).cast("bigint").alias("n"))
    both = rows.select("diff_id", "path", "is_new", F.explode(F.array(side("old", 1, 2), side("new", 3, 4))).alias("h")).where("h.n > 0")
    return both.select("diff_id", "path", F.col("h.side").alias("side"), F.col("h.start").alias("start_line"), (F.col("h.start") + F.col("h.n") - 1).alias("end_line"), "is_new")


def validate_base(base: str) -> str:
    if not base or base.startswith("-"):
        raise ValueError(f"not a usable base revision: {base!r}")
    return base


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True).stdout


def _headers(command: list[str]) -> Iterator[tuple[str, int, str]]:
    """(file, line number, line) of a diff's header and hunk lines, read as the process writes them; each file is a diff of its own."""
    with subprocess.Popen(command, stdout=subprocess.PIPE, text=True, encoding="utf-8", errors="replace") as running:
        file = 0
        for i, line in enumerate(running.stdout):
            file += line.startswith("diff --git ")
            if line.startswith(("diff --git ", "new file mode", "+++ b/", "@@ ")):
                yield str(file), i, line.rstrip("\n")
    if running.returncode:
        raise subprocess.CalledProcessError(running.returncode, command)


def git_hunks(spark: SparkSession, repo: str, base: str, patterns: tuple[str, ...] = ("*.sql", "*.xml")) -> DataFrame:
    """Hunks of the working tree against the merge base, with untracked files as new."""
    start = _git(repo, "merge-base", validate_base(base), "HEAD").strip()
    rows = list(_headers(["git", "-C", repo, "diff", "--unified=0", "--diff-filter=d", start, "--", *patterns]))
    hunks = parse_diff(spark.createDataFrame(rows, "diff_id string, line_no long, line string")).drop("diff_id")
    extra = [p for p in _git(repo, "ls-files", "--others", "--exclude-standard", "--", *patterns).split("\n") if p]
    return hunks.unionByName(spark.createDataFrame([(p, "new", 1, 1 << 40, True) for p in extra], schemas.HUNKS))


def git_show(spark: SparkSession, repo: str, base: str, paths: list[str]) -> DataFrame:
    """(path, text) at the base; text is null where the file is missing there."""
    asked = "".join(f"{validate_base(base)}:{p}\n" for p in paths)
    out = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input=asked.encode(), capture_output=True, check=True).stdout
    rows, at = [], 0
    for p in paths:
        stop = out.index(b"\n", at)
        head = out[at:stop].decode().rsplit(" ", 2)
        at = stop + 1
        if head[-1] == "missing" or head[-2] != "blob":
            rows.append((p, None))
            at += int(head[-1]) + 1 if head[-1].isdigit() else 0
            continue
        size = int(head[-1])
        rows.append((p, out[at : at + size].decode("utf-8", "replace")))
        at += size + 1
    return spark.createDataFrame(rows, "path string, text string")
