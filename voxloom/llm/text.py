"""Column expressions on texts that several operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of the contracts, [\x20\x09-\x0D].
WHITE = "\t\n\x0b\x0c\r "


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def without_white(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters that are not white space."""
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " +"), "")


def joined_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def growing(rows: DataFrame) -> DataFrame:
    """A side of a join whose size grows with the corpus: it has no size bound, so it is never broadcast."""
    return rows.hint("merge")


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


def any_columns(keep: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For an operator that returns rows of ``docs``: its user's columns may have any names, the operator's own among them.

    ``keep(docs, **columns, **options)`` sees them named by position; the arguments that end in ``_col`` name columns.
    """

    @wraps(keep)
    def with_positions(docs: DataFrame, *args, **options) -> DataFrame:
        given = dict(zip(keep.__code__.co_varnames[1 : keep.__code__.co_argcount], args)) | options
        defaults = dict(zip(reversed(keep.__code__.co_varnames[: keep.__code__.co_argcount]), reversed(keep.__defaults__ or ())))
        named = {k: v for k, v in (defaults | given).items() if k.endswith("_col")}
        lower = [c.lower() for c in docs.columns]
        places = {k: f"column{lower.index(v.lower())}" for k, v in named.items()}
        rows = docs.toDF(*[f"column{i}" for i in range(len(lower))])
        return keep(rows, **(given | places)).toDF(*docs.columns)

    return with_positions
