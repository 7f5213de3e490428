"""User columns that travel with an operator's own: whole rows in one struct, so that no names meet."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "row"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column of just this name, dots and blanks in it included."""
    return F.col(quoted(name))


def boxed(docs: DataFrame, names: Iterable[str] | None = None) -> Column:
    """The columns ``names`` of a row, all if not given, as one struct."""
    return F.struct(*[column(c) for c in (docs.columns if names is None else names)]).alias(ROW)


def unboxed(names: Iterable[str], **new: Column) -> list[Column]:
    """The columns ``names`` of the boxed row; those in ``new`` get the given value instead."""
    return [new.get(c, F.col(ROW).getField(c)).alias(c) for c in names]


def texts(rows: pa.StructArray, name: str) -> pa.Array:
    """A column of boxed rows as strings."""
    return rows.field(name).cast(pa.string())
