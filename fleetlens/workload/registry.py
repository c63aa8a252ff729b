"""Registered queries over the driver tables and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.fleet import Fleet
from fleetlens.functions.exprs import shift, timestamp
from fleetlens.sources import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LIB: dict[str, tuple[str, tuple[str, ...]]] = {}
DUCK = B.Dialect("duck")
DIGITS = 6
NUDGE = "0.0000000003"  # keeps exact decimal ties on one side of the rounding border


class Context:
    """What a registered query reads: telemetry views, driver tables, and the common window.

    Lazy plans are kept per session and folder, so queries that start from the same report share its plan (no data is
    cached).
    """

    _plans: dict[tuple[str, int, str], dict[str, DataFrame]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.plans = self._plans.setdefault((spark.sparkContext.applicationId, id(spark), sf_dir), {})
        self.fleet = Fleet(lambda n: self.once(n, lambda: B.view(spark, sf_dir, n)))
        self.end = timestamp(B.ANCHOR)
        self.start = shift(self.end, -B.PERIOD_DAYS * 86400)
        self.width = B.BUCKET_SECONDS

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.plans:
            self.plans[name] = build()
        return self.plans[name]

    def __getitem__(self, name: str) -> DataFrame:
        return self.fleet[name]

    def table(self, name: str) -> DataFrame:
        return B.table(self.spark, self.sf_dir, name)


def tidy(df: DataFrame) -> DataFrame:
    """Stable output for comparison: rounded doubles, zone-less timestamps, plain 64-bit integers."""
    cols = []
    for name, t in df.dtypes:
        c = F.col(f"`{name}`")
        if t in ("double", "float"):
            c = F.round(c.cast("double") + F.lit(float(NUDGE)), DIGITS) + F.lit(0.0)
        elif t.startswith("decimal"):
            c = F.round(c.cast("double") + F.lit(float(NUDGE)), DIGITS) + F.lit(0.0)
        elif t == "timestamp":
            c = c.cast("timestamp_ntz")
        elif t in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        cols.append(c.alias(name))
    return df.select(*cols)


def _resolve(needs: tuple[str, ...]) -> list[str]:
    done: list[str] = []
    parts: list[str] = []

    def add(n: str) -> None:
        if n in done:
            return
        if n in B.VIEWS:
            for dep in B.VIEWS[n][1]:
                add(dep)
            parts.append(f"{n} as ({B.VIEWS[n][0](DUCK)})")
        else:
            sql, deps = LIB[n]
            for dep in deps:
                add(dep)
            parts.append(f"{n} as ({sql})")
        done.append(n)

    for n in needs:
        add(n)
    return parts


def library(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    """A named oracle building block."""
    LIB[name] = (sql, needs)


def oracle(sql: str, needs: tuple[str, ...] = (), floats: tuple[str, ...] = ()) -> str:
    ctes = _resolve(needs)
    head = f"with {', '.join(ctes)} " if ctes else ""
    if floats:
        rep = ", ".join(f"round(cast({c} as double) + {NUDGE}, {DIGITS}) + 0.0 as {c}" for c in floats)
        return f"{head}select * replace ({rep}) from ({sql}) q"
    return f"{head}select * from ({sql}) q"


def query(key: str, sql: str | None = None, needs: tuple[str, ...] = (), floats: tuple[str, ...] = ()):
    """Register ``fn(context) -> DataFrame`` under ``key`` with the SQL that must give the same rows."""

    def wrap(fn: Callable[[Context], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} registered twice")
        QUERIES[key] = lambda spark, sf_dir: tidy(fn(Context(spark, sf_dir)))
        if sql is not None:
            ORACLES[key] = oracle(sql, needs, floats)
        return fn

    return wrap
