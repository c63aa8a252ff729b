"""Reports for any number of host selections and the whole fleet from one assessment.

The fleet is assessed once into a narrow row per host (``host_facts``), which is best written as a table and read again.
Selections are rows ``(selection, server_id)``; every section of every report is then one join with them and one grouped
aggregate, however many selections there are. Sections of the whole fleet need no join; they carry the name ``*``.

Joins with hosts, names, tokens and documents are sort-merge joins (``spread``): all of these grow with the fleet, and what the
planner takes for their size is that of compressed files, by which it would send a whole fleet through the driver.

Hosts in several selections count in each, hosts asked for twice count once, tokens without a host are counted as
unmatched, and a selection without any host appears in the summary only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.exprs import shift
from fleetlens.operators.kernels import latest_n
from fleetlens.operators.selection import addresses

HOST = "server_id"
WHOLE = "*"
WASTE = ("over_provisioned", "idle")
KINDS = ("hostname", "ip", "public_id", "pair")
CONTRACT_VERSION = "1.0"  # fixed value


def spread(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never collected for a broadcast, however small its files are."""
    return df.hint("merge")


# --- selections ---------------------------------------------------------------------------------------------------

def known_names(inventory: DataFrame) -> DataFrame:
    """Every name a host answers to: ``(server_id, kind, token)``, a pair being ``hostname~address`` or ``hostname~public_id``."""
    ip = addresses(inventory).select(HOST, "hostname", F.col("address").alias("token"))

    def row(kind: str, token: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), token.alias("token"))

    own = inventory.select(HOST, F.inline(F.array(
        row("hostname", F.col("hostname")), row("public_id", F.col("public_id")),
        row("pair", F.concat("hostname", F.lit("~"), "public_id")))))
    by_ip = ip.select(HOST, F.inline(F.array(row("ip", F.col("token")), row("pair", F.concat("hostname", F.lit("~"), "token")))))
    return own.unionByName(by_ip).filter(F.col("token").isNotNull())


def selection_members(inventory: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(selection, server_id)`` of the hosts that any token ``(selection, kind, token)`` names, each once."""
    return known_names(inventory).join(spread(tokens.select("selection", "kind", "token")), ["kind", "token"]).select("selection", HOST).distinct()


def selection_tokens(inventory: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens asked for per selection and how many of them name no host."""
    asked = tokens.select("selection", "kind", "token").distinct()
    found = known_names(inventory).select("kind", "token").distinct().withColumn("_hit", F.lit(True))
    return asked.join(found, ["kind", "token"], "left").groupBy("selection").agg(
        F.count("*").alias("tokens"), F.count_if(F.col("_hit").isNull()).alias("unmatched"))


# --- facts --------------------------------------------------------------------------------------------------------

def host_facts(inventory: DataFrame, rows: DataFrame, support: DataFrame, signals: DataFrame) -> DataFrame:
    """One narrow row per host of the inventory: capacity, verdict, and all sections it counts in.

    ``rows`` are the report rows of ``action_targets``; what is unknown of a host gives no section.
    """
    kinds = signals.groupBy(HOST).agg(F.collect_set("kind").alias("_kinds"))  # three kinds at most
    r = rows.select(HOST, "classification", "causes", "risk_level", "risk_rank", "cpu_p95", "mem_p95", "runway_days", "driving_mount")
    f = inventory.select(HOST, "hostname", "cpu_cores", "mem_total_bytes").join(r, HOST, "left").join(
        support.select(HOST, "support"), HOST, "left").join(kinds, HOST, "left")
    under = F.col("classification") == "under_provisioned"
    none = F.array().cast("array<string>")

    def named(prefix: str, values: Column) -> Column:
        return F.transform(F.array_compact(F.coalesce(values, none)), lambda v: F.concat(F.lit(prefix + ":"), v))

    sections = F.concat(
        named("class", F.array("classification")), named("cause", F.when(under, F.col("causes"))),
        named("support", F.array("support")), named("attention", F.col("_kinds")),
        F.when((F.col("runway_days") < 30) & F.col("driving_mount").isNotNull(), F.array(F.lit("imminent"))).otherwise(none))
    return f.select(HOST, "hostname", "cpu_cores", "mem_total_bytes", "classification", "risk_level", "risk_rank", "cpu_p95", "mem_p95",
                    sections.alias("sections"))


# --- sections -----------------------------------------------------------------------------------------------------

def _selected(facts: DataFrame, members: DataFrame) -> DataFrame:
    """Facts once per selection, and once for the whole fleet."""
    return facts.join(spread(members), HOST).unionByName(facts.withColumn("selection", F.lit(WHOLE)))


def section_counts(facts: DataFrame, members: DataFrame) -> DataFrame:
    """Hosts per selection and section."""
    rows = _selected(facts.select(HOST, "sections"), members)
    return rows.select("selection", F.explode("sections").alias("section")).groupBy("selection", "section").agg(F.count("*").alias("hosts"))


def selection_summary(facts: DataFrame, members: DataFrame, tokens: DataFrame) -> DataFrame:
    """Size, load and outcome of every selection; ``tokens`` as ``selection_tokens`` gives them."""
    rows = _selected(facts.drop("sections", "hostname"), members)
    s = rows.groupBy("selection").agg(
        F.count("*").alias("hosts"), F.sum("cpu_cores").alias("cpu_cores"), F.sum("mem_total_bytes").alias("mem_total_bytes"),
        F.avg("cpu_p95").alias("cpu_p95_avg"), F.max("cpu_p95").alias("cpu_p95_max"), F.avg("mem_p95").alias("mem_p95_avg"),
        F.count_if(F.col("classification") == "under_provisioned").alias("under_count"),
        F.count_if(F.col("classification").isin(*WASTE)).alias("efficiency_count"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk"))
    counts = ("hosts", "under_count", "efficiency_count", "high_risk", "tokens", "unmatched")
    return tokens.join(s, "selection", "full").fillna(0, list(counts))


def top_hosts(facts: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """The ``n`` riskiest hosts of every selection in report order. Groups are limited before the shuffle."""
    rows = _selected(facts.select(HOST, "hostname", "risk_level", "risk_rank", "cpu_p95"), members)
    order = [F.asc_nulls_last("risk_rank"), F.desc(F.coalesce("cpu_p95", F.lit(0.0))), F.asc("hostname"), F.asc(HOST)]
    return latest_n(rows, ["selection"], order, n, "place")


# --- documents ----------------------------------------------------------------------------------------------------

def _headers(inventory: DataFrame, members: DataFrame, tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """Filters, warnings and number of documents per selection. A list holds tokens of one request, which bound it."""
    trimmed = F.when(F.col("kind") == "pair", F.col("token")).otherwise(F.trim("token"))
    asked = tokens.select("selection", "kind", trimmed.alias("token")).filter(F.col("token") != "").distinct()
    hits = known_names(inventory).join(spread(asked.select("kind", "token").distinct()), ["kind", "token"], "left_semi").groupBy("kind", "token").agg(
        F.count_distinct(HOST).alias("_n"))

    def listed(where: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(where, F.col("token"))))

    kind, n = F.col("kind"), F.col("_n")
    h = asked.join(spread(hits), ["kind", "token"], "left").groupBy("selection").agg(
        *[listed(kind == k).alias(k) for k in KINDS], listed((kind == "hostname") & (n > 1)).alias("ambiguous_hostnames"),
        listed((kind == "pair") & n.isNull()).alias("unresolved_pairs"), listed((kind != "pair") & n.isNull()).alias("unmatched_filters"))
    found = members.join(spread(rows.select(HOST)), HOST).groupBy("selection").agg(F.count("*").alias("count"))
    lists = [c for c in h.columns if c != "selection"]
    whole = rows.agg(F.count("*").alias("count")).select(F.lit(WHOLE).alias("selection"), *[F.array().cast("array<string>").alias(c) for c in lists], "count")
    return h.join(spread(found), "selection", "left").fillna(0, ["count"]).unionByName(whole)


def assessment_envelopes(rows: DataFrame, inventory: DataFrame, members: DataFrame, tokens: DataFrame, window_days: int, end: Column,
                         generated_at: Column) -> DataFrame:
    """The assessment of every selection as JSON: ``(selection, part, server_id, document)``. ``rows`` are read four times, so
    they should be a written table.

    Part ``envelope`` is one document per selection with contract version, window, filters, warnings and the number of
    servers; part ``server`` one document per assessed host of it. The parts stay separate rows, so a selection of the whole
    fleet is written by many tasks. Lists are in the order of their text. Warnings: names that several hosts share, pairs and
    other tokens that no host answers to. Blanks around tokens do not count; empty and unknown tokens ask for nothing.
    """
    window = F.struct(F.lit(window_days).alias("days"), shift(end, -window_days * 86400).alias("start"), end.alias("end"),
                      F.lit("observation window; shorter histories lower the confidence").alias("basis"))
    head = _headers(inventory, members, tokens, rows).select(
        "selection", F.lit("envelope").alias("part"), F.lit(None).cast(rows.schema[HOST].dataType).alias(HOST), F.to_json(F.struct(
            F.lit(CONTRACT_VERSION).alias("contract_version"), generated_at.alias("generated_at"), window.alias("window"),
            F.struct(*KINDS).alias("filter"), F.struct("ambiguous_hostnames", "unresolved_pairs", "unmatched_filters").alias("warnings"),
            "count")).alias("document"))
    docs = rows.select(HOST, F.to_json(F.struct(*[c for c in rows.columns if c != HOST])).alias("document"))
    return head.unionByName(_selected(docs, members).select("selection", F.lit("server").alias("part"), HOST, "document"))


def write_envelopes(documents: DataFrame, path: str) -> None:
    """A folder per selection and part with one JSON document a line."""
    documents.select("selection", "part", "document").write.mode("overwrite").partitionBy("selection", "part").text(path)
