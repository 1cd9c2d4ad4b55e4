"""CSV sinks with exact quoting: text always quoted, quotes doubled, other values bare, nulls empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import schema
from colonnade.operators.frame import labels, row_id, sorted_columns
from colonnade.storage import Files


def quote(text: str | None) -> str:
    return '"' + (text or "").replace('"', '""') + '"'


def _cell(df: DataFrame, column: str) -> Column:
    v = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.coalesce(F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))
    return F.coalesce(v.cast("string"), F.lit(""))


def column_order(df: DataFrame) -> list[str]:
    """Row id, sorted columns, the rest by name, labels last; each once."""
    first = [c for c in [row_id(df)] if c]
    marked, last = sorted(sorted_columns(df)), sorted(labels(df))
    rest = sorted(c for c in df.columns if c not in {*first, *marked, *last})
    return list(dict.fromkeys([*first, *marked, *rest, *last]))


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *[_cell(df, c) for c in column_order(df)]).alias("value"))


def export_frame(df: DataFrame, folder: str, name: str = "", description: str = "", notes: bool = False) -> None:
    """Lines as text files under ``folder``, written by the executors; the header, and on request the notes, in a file of their own before them."""
    head = []
    if notes:
        marked, last = sorted(sorted_columns(df)), sorted(labels(df))
        pairs = [("name", name), ("description", description), ("row ID", row_id(df)), ("sort column", marked[0] if marked else None)]
        head += [f"{quote(k)},{quote(v)}" for k, v in pairs]
        head += [",".join([quote("label columns"), *last]), ",".join([quote("sorted columns"), *marked]), ""]
    csv_lines(df).write.mode("overwrite").text(folder)
    _side_file(df, f"{folder}/header.csv", [*head, ",".join(column_order(df))])


def export_vector(df: DataFrame, column: str, folder: str) -> None:
    df.select(_cell(df, column).alias("value")).write.mode("overwrite").text(folder)


def _side_file(df: DataFrame, path: str, lines: list[str]) -> None:
    Files(df.sparkSession).write(path, "".join(f"{x}\n" for x in lines))


def export_namespace(space, folder: str) -> list[str]:
    """Every frame, vector and scalar of a namespace under ``folder``; the names of what was written."""
    written, scalars = [], []
    for name in space.names():
        df = space.get(name)
        kind = space.kind(name)
        if kind == "scalar":
            value = df.first()[0]
            scalars.append(f"{quote(name)},{quote(value) if isinstance(value, str) else value}")
        elif kind == "vector":
            export_vector(df.orderBy("rid"), next(c for c in df.columns if c != "rid"), f"{folder}/{name}.vector.csv")
            written.append(f"{name}.vector.csv")
        else:
            export_frame(df, f"{folder}/{name}.dataFrame.csv", name, notes=True)
            written.append(f"{name}.dataFrame.csv")
    if scalars:
        Files(space.space.spark).write(f"{folder}/scalars.csv", "\n".join(scalars) + "\n")
        written.append("scalars.csv")
    return written
