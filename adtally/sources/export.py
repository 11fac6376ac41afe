"""Sinks: delimited tables and JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from adtally.functions.text import escape_html


def write_table(table: DataFrame, path: str, group: str | None = None) -> None:
    """Write an export table as CSV with headers, rows in ``row_order``.

    With a ``group`` every group gets its own folder. Its rows are the days of a period and
    a total, so one file per group stays small however many groups there are.
    """
    if group is None:
        ordered = table.orderBy("row_order").drop("row_order")
        ordered.write.mode("overwrite").option("header", True).csv(path)
        return
    ordered = table.repartition(group).sortWithinPartitions(group, "row_order").drop("row_order")
    ordered.write.mode("overwrite").partitionBy(group).option("header", True).csv(path)


def json_rows(df: DataFrame, escape: bool = False, output: str = "json") -> DataFrame:
    """Every row as one JSON text with its nulls; ``escape`` makes its texts safe for HTML.

    Numbers and booleans are never escaped, and texts that are numbers have nothing to
    escape. Texts inside arrays, structs and the values of maps are escaped too.
    """
    fields = df.schema.fields
    values = [
        (_escaped(F.col(f.name), f.dataType) if escape else F.col(f.name)).alias(f.name) for f in fields
    ]
    return df.select(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias(output))


def write_json_rows(df: DataFrame, path: str, escape: bool = False) -> None:
    json_rows(df, escape).write.mode("overwrite").text(path)


def _escaped(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return escape_html(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda item: _escaped(item, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda key, item: _escaped(item, kind.valueType))
    if isinstance(kind, StructType):
        inner = [_escaped(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*inner))
    return value
