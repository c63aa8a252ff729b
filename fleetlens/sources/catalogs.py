"""OS support catalog: one row per product and release, loaded from a JSON file or from the small built-in set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = "product string, pos int, cycle string, build string, support date, eol date, extended date"

# Release dates of a few common systems (product, cycle, build, support, eol, extended support).
COMMON_RELEASES = [
    ("ubuntu", "22.04", None, "2024-09-30", "2027-04-01", "2032-04-09"),
    ("ubuntu", "20.04", None, "2022-10-01", "2025-05-31", "2030-04-02"),
    ("ubuntu", "18.04", None, "2023-05-31", "2023-05-31", "2028-04-01"),
    ("debian", "12", None, None, "2026-07-11", "2028-06-30"),
    ("debian", "11", None, None, "2024-08-14", "2026-08-31"),
    ("debian", "10", None, None, "2022-09-10", "2024-06-30"),
    ("rhel", "9", None, "2027-05-31", "2032-05-31", "2036-05-31"),
    ("rhel", "8", None, "2024-05-31", "2029-05-31", "2033-05-31"),
    ("rhel", "7", None, "2019-08-06", "2024-06-30", "2029-05-31"),
    ("rhel", "6", None, "2016-05-10", "2020-11-30", "2024-06-30"),
    ("rocky-linux", "9", None, "2027-05-31", "2032-05-31", None),
    ("rocky-linux", "8", None, "2024-05-31", "2029-05-31", None),
    ("centos", "7", None, "2020-08-06", "2024-06-30", None),
    ("windows-server", "2022", "20348", "2026-10-13", "2031-10-14", None),
    ("windows-server", "2019", "17763", "2024-01-09", "2029-01-09", None),
    ("windows-server", "1809-sac", "17763", "2020-11-10", "2020-11-10", None),
    ("windows-server", "2016", "14393", "2022-01-11", "2027-01-12", "2030-01-12"),
    ("windows-server", "2012-r2", "9600", "2018-10-09", "2023-10-10", "2026-10-13"),
]


def common_releases(spark: SparkSession) -> DataFrame:
    rows = [(p, i, c, b, s, e, x) for i, (p, c, b, s, e, x) in enumerate(COMMON_RELEASES)]
    df = spark.createDataFrame(rows, "product string, pos int, cycle string, build string, support string, eol string, extended string")
    return df.select("product", "pos", "cycle", "build", *[F.to_date(c).alias(c) for c in ("support", "eol", "extended")])


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog file ``{product: [{cycle, build, support, eol, extendedSupport}, ...]}``; the list order is kept."""
    entry = "array<struct<cycle:string,build:string,support:string,eol:string,extendedSupport:string>>"
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("product", "entries"))
    rows = rows.select("product", F.posexplode("entries").alias("pos", "e"))
    return rows.select("product", "pos", "e.cycle", "e.build", F.to_date("e.support").alias("support"),
                       F.to_date("e.eol").alias("eol"), F.to_date("e.extendedSupport").alias("extended"))


def save_catalog(catalog: DataFrame, path: str) -> None:
    """Writes a catalog in the form that ``load_catalog`` reads: one JSON object, a list of releases for each product."""
    entry = F.struct("pos", F.struct("cycle", "build", *[F.col(a).cast("string").alias(b) for a, b in (("support", "support"), ("eol", "eol"), ("extended", "extendedSupport"))]).alias("e"))
    lists = catalog.groupBy("product").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("entries"))
    whole = lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("product", "entries")))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)
