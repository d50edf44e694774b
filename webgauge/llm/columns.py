"""Working columns beside columns of the user, whatever those are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A column name that is taken as it stands, dots included."""
    return "`" + name.replace("`", "``") + "`"


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` that are not called one of ``names``; names differ by more than case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def packed(df: DataFrame, columns: list[str] | None = None, name: str = "row") -> Column:
    """The user's columns as one, so that working columns beside it cannot clash with them."""
    return F.struct(*[F.col(quoted(c)) for c in (df.columns if columns is None else columns)]).alias(name)


def unpacked(columns: list[str], name: str = "row") -> list[Column]:
    return [F.col(f"{quoted(name)}.{quoted(c)}").alias(c) for c in columns]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_whole_rows(df: DataFrame, func: Callable[[Iterator[pa.RecordBatch], str], Iterator[pa.RecordBatch]], column: str, more: T.StructField | None = None) -> DataFrame:
    """``df.mapInArrow`` for rows of any column names, ``column`` being the one that ``func`` reads.

    ``func`` takes the batches and the name that this column has in them, and gives the columns back in their order,
    followed by ``more`` under any name.
    """
    numbered = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    place = [c.lower() for c in df.columns].index(column.lower())
    fields = [*numbered.schema.fields, *([T.StructField(f"c{len(df.columns)}", more.dataType)] if more else [])]
    out = numbered.mapInArrow(lambda batches: (b.rename_columns([f.name for f in fields]) for b in func(batches, f"c{place}")), T.StructType(fields))
    return out.toDF(*df.columns, *([more.name] if more else []))
