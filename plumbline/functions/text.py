"""Parts of a text by line and column, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_range(text: Column, first: int, last: int) -> Column:
    """Lines `first` to `last` (from 1), joined by line feeds."""
    return F.array_join(F.slice(F.split(text, "\n"), max(first, 1), max(last - max(first, 1) + 1, 0)), "\n")


def text_slice(text: Column, start_line: int, start_column: int, end_line: int, end_column: int) -> Column:
    """Characters from a place up to, not including, another; lines and columns from 1. An end column of 0 or less: the line's end."""
    first, last, start = max(start_line, 1), max(end_line, 1), max(start_column, 1) - 1
    if last < first:
        return F.lit("")

    def part(line: Column, i: Column) -> Column:
        n = F.length(line)
        begin = F.when(i == 0, F.least(F.lit(start), n)).otherwise(0)
        end = F.when(i == last - first, F.least(F.lit(end_column - 1), n)).otherwise(n) if end_column > 0 else n
        return F.substring(line, begin + 1, F.greatest(end - begin, F.lit(0)))

    return F.array_join(F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), first, last - first + 1), part), "\n")
