"""Registration of queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.plans.views import VIEW_SQL, Views
from locusframe.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def r6(value: Column | str) -> Column:
    """Round to six places without a negative zero."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6) + F.lit(0.0)


def sql6(expression: str) -> str:
    """`r6` in SQL."""
    return f"round({expression}, 6) + 0.0e0"


def r9(value: Column | str) -> Column:
    """Round to nine places: ratios and short products, which may end in a 5 at the seventh."""
    return F.round(F.col(value) if isinstance(value, str) else value, 9) + F.lit(0.0)


def sql9(expression: str) -> str:
    """`r9` in SQL."""
    return f"round({expression}, 9) + 0.0e0"


def sql_order(column: str, seed: int) -> str:
    """`seeded_order` of a non-negative id in SQL."""
    key = f"(({column} % 2147483647 * 2654435761 + {seed * 40503}) % 4294967296)"
    for _ in range(2):
        key = f"(xor({key}, {key} >> 15) * 1540483477 % 4294967296)"
    return key


def with_views(names: str, body: str) -> str:
    """`body` behind the views it needs, with the views those need first."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for needed in VIEW_SQL[name][0]:
            add(needed)
        order.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEW_SQL[n][1]})" for n in order)
    # A body may bring its own WITH list.
    body = body.strip()
    if not order:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(views: str = "", sql: str | None = None) -> Callable:
    """Register `fn(v)` under its name; `sql` is the check over the named views."""

    def register(fn: Callable[[Views], DataFrame]) -> Callable:
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Views(tune(spark), folder))

        QUERIES[fn.__name__] = run
        if sql is not None:
            CHECKS[fn.__name__] = with_views(views, sql)
        return fn

    return register
