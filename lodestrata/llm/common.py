"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut

__all__ = ["BROADCAST_ROWS", "LOWER", "NON_SPACES", "SPACES", "UPPER", "cut", "id_key", "maybe_broadcast", "quoted", "steps", "text_key", "without"]

#: White space and word patterns of the contracts.
SPACES = r"[\x20\x09-\x0D]+"
NON_SPACES = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows that a hinted broadcast may have at most; beyond it a shuffle join is planned.
BROADCAST_ROWS = 1_000_000


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def id_key(col: Column) -> Column:
    """An id as a string that is never null: joins and deduplication on it share one shuffle, which null-safe equality would not."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def text_key(text_col: str) -> Column:
    """A hash of a text (null counts as empty): with the id it tells rows apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def steps(first: int | Column, last: Column) -> Column:
    """[first, ..., last]; empty when last < first (sequence() would count down)."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only for a counted, bounded side."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def without(df: DataFrame, marked: DataFrame, k: Column, x: Column) -> DataFrame:
    """`df` without the rows whose keys are marked (__ls_k, __ls_x, lost, rows) as lost, and with one of those that are kept and repeated."""
    tagged = df.withColumns({"__ls_k": k, "__ls_x": x})
    lost, twice = marked.filter("lost").select("__ls_k", "__ls_x"), marked.filter("NOT lost AND rows > 1").select("__ls_k", "__ls_x")
    kept = tagged.join(maybe_broadcast(lost, lost.count()), ["__ls_k", "__ls_x"], "left_anti")
    n = twice.count()
    if n:
        once = kept.join(maybe_broadcast(twice, n), ["__ls_k", "__ls_x"], "left_semi").dropDuplicates(["__ls_k", "__ls_x"])
        kept = kept.join(maybe_broadcast(twice, n), ["__ls_k", "__ls_x"], "left_anti").unionByName(once)
    return kept.select(*quoted(df.columns))
