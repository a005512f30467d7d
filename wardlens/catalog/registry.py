"""Query registration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .views import VIEWS, Tables

# Both engines keep six digits of a double by the same arithmetic. The threshold is off-centre because averages of
# two-decimal inputs often end exactly in ...5, where a difference in the last bit would decide the digit.
SCALE, THRESHOLD = 1_000_000, 0.497


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def _with_views(sql: str, views: str) -> str:
    """Prefix the statement with the derived views it uses (dependencies first)."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for dependency in VIEWS[name].needs:
            need(dependency)
        ordered.append(name)

    for name in views.split():
        need(name)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].sql})" for name in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"


def query(
    covers: str, views: str = "", doubles: str = "", sql: str | None = None
) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query under its function's name.

    ``covers`` lists the blueprint ids; ``views`` the derived views the SQL uses; ``doubles`` the columns that both
    sides round to six digits, since engines add floating-point numbers in different orders.
    """
    rounded = doubles.split()

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(Tables(spark, sf_dir))
            return df.select(*[
                (F.floor(F.col(c).cast("double") * float(SCALE) + THRESHOLD) / float(SCALE)).alias(c)
                if c in rounded else F.col(c)
                for c in df.columns
            ])

        statement = None
        if sql is not None:
            statement = _with_views(sql, views)
            if rounded:
                replaced = ", ".join(
                    f"floor(CAST({c} AS DOUBLE) * {SCALE} + {THRESHOLD}) / {SCALE} AS {c}" for c in rounded)
                statement = f"SELECT * REPLACE ({replaced}) FROM (\n{statement}\n)"
        REGISTRY[build.__name__] = Query(build.__name__, run, statement, tuple(covers.split()))
        return build

    return register
