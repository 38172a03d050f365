"""Register of queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}
SETTINGS = {"spark.sql.session.timeZone": "UTC"}  # the tables' clocks are UTC


def query(name: str, oracle: str | None = None):
    """Registers a query; ``oracle`` is the SQL giving the same table."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            for key, value in SETTINGS.items():
                if spark.conf.get(key, None) != value:
                    spark.conf.set(key, value)
            return fn(spark, folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def view(name: str, body: str, *needs: str) -> None:
    VIEWS[name] = (body.strip(), needs)


def sql(needs: str, body: str) -> str:
    """``body`` under a WITH clause holding the named views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for other in VIEWS[name][1]:
            add(other)
        order.append(name)

    for name in needs.split():
        add(name)
    ctes = [f"{n} AS (\n{VIEWS[n][0]}\n)" for n in order]
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = "," + body[4:]
        return "WITH " + ",\n".join(ctes) + body
    return "WITH " + ",\n".join(ctes) + "\n" + body


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A given table, cut to the columns used so that the scan reads no more."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def micros(column: str):
    """Microseconds of a timestamp without zone, read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name)
        if f.dataType.simpleString() in ("double", "float") else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
