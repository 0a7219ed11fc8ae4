"""Rule tables as data: the same rows as a small DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


class Rules:
    """A table of fixed rows; what is broadcast of it doesn't grow with the data."""

    def __init__(self, name: str, columns: str, rows: list[tuple]):
        self.name, self.columns, self.rows = name, columns, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.columns)

    @property
    def sql(self) -> str:
        """A common table expression."""
        names, types = zip(*(c.split() for c in self.columns.split(", ")), strict=True)
        one = lambda v, t: "CAST(NULL AS " + SQL_TYPES[t] + ")" if v is None else f"CAST('{v}' AS {SQL_TYPES[t]})" if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
        rows = ", ".join("(" + ", ".join(map(one, r, types)) + ")" for r in self.rows)
        return f"{self.name}({', '.join(names)}) AS (VALUES {rows})"
