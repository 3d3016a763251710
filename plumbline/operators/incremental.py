"""Checks of what a diff changed: files of a diff found among checked paths, rules on them, violations kept by hunk."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.engine import check, in_hunks
from plumbline.operators.parse import shuffled
from plumbline.operators.rules import Rule
from plumbline.sources import mapper
from plumbline.sources.files import file_checks


def _normal(path: Column) -> Column:
    """Forward slashes, without a leading `./` or a trailing slash; the whole repository (`.`, `/`) is the empty path."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+|/+$", "")
    return F.when(plain.isin(".", "/"), F.lit("")).otherwise(plain)


def _suffixes(path: Column) -> Column:
    """The path and what is left of it after each of its slashes, and the empty path."""
    parts = F.split(path, "/")
    own = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))
    return F.array_distinct(F.concat(own, F.array(F.lit(""))))


def match_paths(files: DataFrame, diff: DataFrame) -> DataFrame:
    """files (file_path), diff (path) -> (file_path, path): the path of the diff that names the file, if one does.

    A diff's paths begin at the repository's root and the files' elsewhere, so either may be the end of the other, after a slash. Suffixes
    are joined by equality, and merged: estimates go by compressed sizes, and paths compress well. Of several paths the longest counts.
    """
    f = files.select("file_path").distinct().withColumn("f", _normal(F.col("file_path")))
    d = diff.select("path").distinct().withColumn("p", _normal(F.col("path")))
    ends = f.select("file_path", F.explode(_suffixes(F.col("f"))).alias("p")).join(shuffled(d), "p").select("file_path", "path", "p")
    longer = d.select("path", "p", F.explode(_suffixes(F.col("p"))).alias("f")).where("f <> ''").join(shuffled(f), "f").select("file_path", "path", "p")
    return ends.unionByName(longer).groupBy("file_path").agg(F.max_by("path", F.struct(F.length("p"), "path")).alias("path"))


def hunks_of_files(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """hunks with the files' own paths."""
    return match_paths(files, hunks).join(shuffled(hunks), "path").drop("path").withColumnRenamed("file_path", "path")


def check_diff(files: DataFrame, hunks: DataFrame, rules: Iterable[Rule] | None = None, mappers: DataFrame | None = None, statement_types: dict[str, str] | None = None, dialect: str = "generic", fallback: tuple[str, ...] = (), **options) -> DataFrame:
    """Violations of changed files: of scripts and mapper statements those that touch a hunk, and all checks of a file's bytes.

    files (file_path, script_type, content, text), mappers (file_path, content, text); files that the diff does not name are not parsed.
    """
    own = hunks_of_files(files, hunks)
    named = files.join(own.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    found = in_hunks(check(named.select("file_path", "script_type", "text"), rules, dialect, fallback, **options), own)
    out = found.unionByName(file_checks(named))
    if mappers is None:
        return out
    own = hunks_of_files(mappers, hunks)
    named = mappers.join(own.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    scripts = mapper.as_scripts(mapper.mapper_sql(named.select("file_path", "text")), statement_types)
    return out.unionByName(in_hunks(check(scripts, rules, dialect, fallback, **options), own)).unionByName(file_checks(named.withColumn("script_type", F.lit("mapper"))))
