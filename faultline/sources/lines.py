"""Pasted panes to numbered lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, clean_text


def reader(finish: Callable[[DataFrame], DataFrame]) -> Callable:
    """A reader that finishes what it is told. What it is told stays at hand as .told, so that a union of readers is finished once."""

    def of(told: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        @wraps(told)
        def finished(rows: DataFrame) -> DataFrame:
            return finish(told(rows))

        finished.told = told
        return finished

    return of


def pane_lines(text: Column) -> Column:
    """The cleaned lines of a text; one empty line at the end is dropped, null text has none."""
    parts = lambda t: F.when(t.contains("\r"), F.split(t, "\r\n|\r|\n")).otherwise(F.split(t, "\n"))
    some = lambda p: F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p)
    # Bound: a pane is cleaned and cut once, not by each of the names.
    return bound(clean_text(text), lambda t: bound(parts(t), some))


def split_lines(panes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line): cleaned lines numbered from 1."""
    rows = panes.select(F.col(id_col), F.posexplode(pane_lines(F.col(text_col))).alias("pos", "line"))
    return rows.select(id_col, (F.col("pos") + 1).alias("line_no"), "line")


def line_at(text: Column, offset: Column) -> Column:
    """The 1-based line that holds a character offset of a text."""
    before = F.substring(F.regexp_replace(text, "\r\n?", "\n"), F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")
