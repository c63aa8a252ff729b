"""Choosing hosts and jobs: search, tokens, pairs, id lists, job history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOST = "server_id"
LIST_COLUMNS = ["server_id", "public_id", "hostname", "os_family", "os_id", "os_version", "kernel_version", "product_name",
                "cpu_cores", "mem_total_bytes", "last_seen_at", "boot_time"]


def search(inventory: DataFrame, text: str, page: int = 1, limit: int = 20) -> DataFrame:
    """Hosts whose name contains the text (any case), by name. The text is matched literally."""
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    rows = inventory.filter(F.col("hostname").ilike(f"%{safe}%")) if text else inventory
    return rows.orderBy("hostname", HOST).offset((page - 1) * limit).limit(limit)


def list_columns(inventory: DataFrame) -> DataFrame:
    """The narrow columns of the list; nested inventory is never read."""
    return inventory.select(*LIST_COLUMNS)


def addresses(inventory: DataFrame) -> DataFrame:
    """(host, address) of every interface."""
    n = inventory.select(HOST, "hostname", F.explode("net_interfaces").alias("n"))
    return n.select(HOST, "hostname", F.explode("n.addresses").alias("a")).select(HOST, "hostname", F.col("a.address").alias("address"))


def match_tokens(inventory: DataFrame, hostnames: DataFrame | None = None, ips: DataFrame | None = None,
                 public_ids: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Ids of the hosts matching any token. Token tables have one column ``token``; pairs ``hostname, discriminator``
    (an address or a public id). Without any table every host matches."""
    if hostnames is None and ips is None and public_ids is None and pairs is None:
        return inventory.select(HOST)
    found = []
    if hostnames is not None:
        found.append(inventory.join(hostnames.select(F.col("token").alias("hostname")), "hostname", "left_semi").select(HOST))
    if public_ids is not None:
        found.append(inventory.join(public_ids.select(F.col("token").alias("public_id")), "public_id", "left_semi").select(HOST))
    if ips is not None:
        found.append(addresses(inventory).join(ips.select(F.col("token").alias("address")), "address", "left_semi").select(HOST))
    if pairs is not None:
        found.append(_pair_hits(inventory, pairs).select(HOST))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _pair_hits(inventory: DataFrame, pairs: DataFrame) -> DataFrame:
    known = addresses(inventory).select(HOST, "hostname", F.col("address").alias("discriminator")).unionByName(
        inventory.select(HOST, "hostname", F.col("public_id").alias("discriminator")))
    return known.join(pairs, ["hostname", "discriminator"])


def unmatched_tokens(inventory: DataFrame, hostnames: DataFrame, ips: DataFrame, public_ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tokens no host answers to: (kind, token)."""
    h = hostnames.join(inventory.select(F.col("hostname").alias("token")), "token", "left_anti").select(F.lit("hostname").alias("kind"), "token")
    i = ips.join(addresses(inventory).select(F.col("address").alias("token")), "token", "left_anti").select(F.lit("ip").alias("kind"), "token")
    p = public_ids.join(inventory.select(F.col("public_id").alias("token")), "token", "left_anti").select(F.lit("public_id").alias("kind"), "token")
    q = pairs.join(_pair_hits(inventory, pairs).select("hostname", "discriminator"), ["hostname", "discriminator"], "left_anti").select(
        F.lit("pair").alias("kind"), F.concat_ws("~", "hostname", "discriminator").alias("token"))
    return h.unionByName(i).unionByName(p).unionByName(q)


def ambiguous_names(inventory: DataFrame, hostnames: DataFrame) -> DataFrame:
    """Requested names that two or more hosts share."""
    twice = inventory.groupBy("hostname").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(F.col("hostname").alias("token"))
    return hostnames.select("token").intersect(twice)


def batch_get(df: DataFrame, ids: DataFrame, key: str = "public_id") -> DataFrame:
    """Rows of the wanted ids; missing ids are simply absent."""
    return df.join(ids.select(key), key, "left_semi")


def optional_filter(df: DataFrame, column: str, value) -> DataFrame:
    """Filter only when a value is given."""
    return df if value is None else df.filter(F.col(column) == value)


def keyset_page(df: DataFrame, ts: str, cursor: Column, limit: int, horizon_days: int | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Newest rows before the cursor, at most ``horizon_days`` back if that is given."""
    page = df.filter(F.col(ts) < cursor)
    if horizon_days is not None:
        page = page.filter(F.col(ts) >= F.timestamp_micros(F.unix_micros(cursor) - F.lit(horizon_days * 86400 * 1_000_000)))
    return page.orderBy(F.desc(ts), *[F.asc(t) for t in tie]).limit(limit)


# --- jobs ---------------------------------------------------------------------------------------------------------

def job_servers() -> Column:
    """Public ids of a job: the single key and the list key of its parameters."""
    one = F.get_json_object("input_params", "$.server_id")
    many = F.from_json(F.get_json_object("input_params", "$.server_ids"), "array<string>")
    return F.concat(F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>")),
                    F.coalesce(many, F.array().cast("array<string>")))


def jobs_matching(jobs: DataFrame, ids: DataFrame | None = None, days: int = 0, now: Column | None = None, scope: str | None = None,
                  job_type: str | None = None) -> DataFrame:
    """Jobs by time (0 days: all), scope, type and by any of the wanted public ids."""
    if days > 0:
        jobs = jobs.filter(F.col("created_at") > F.timestamp_micros(F.unix_micros(now) - F.lit(days * 86400 * 1_000_000)))
    jobs = optional_filter(optional_filter(jobs, "scope", scope), "job_type", job_type)
    if ids is None:
        return jobs
    hits = jobs.select("job_id", F.explode(job_servers()).alias("public_id")).join(ids.select("public_id"), "public_id", "left_semi")
    return jobs.join(hits.select("job_id").distinct(), "job_id", "left_semi")


def job_history(jobs: DataFrame, view: str = "all", scope: str | None = None) -> DataFrame:
    """Jobs of one or both types; ``selection`` and ``single`` split the server scope by the number of hosts."""
    types = ["customer_report", "engineer_report"] if view == "all" else [f"{view}_report"]
    out = jobs.filter(F.col("job_type").isin(types))
    if scope in ("selection", "single"):
        n = F.size(job_servers())
        return out.filter((F.col("scope") == "server") & (n >= 2 if scope == "selection" else n == 1))
    return optional_filter(out, "scope", scope)


def newest_jobs(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.asc("job_id")).limit(limit)


def retained(jobs: DataFrame, now: Column, days: int, column: str = "finished_at") -> DataFrame:
    """Jobs younger than the retention; unfinished ones stay."""
    floor = F.timestamp_micros(F.unix_micros(now) - F.lit(days * 86400 * 1_000_000))
    return jobs.filter(F.col(column).isNull() | (F.col(column) >= floor))


def snapshot_key(scope: Column, params: Column, anchor: Column) -> list[Column]:
    """Identity of a stored report: hash of scope and canonical parameters, and the minute of its anchor.

    Variant objects hold their keys in order at every depth, so equal parameters give equal text; what is no JSON stays.
    """
    canonical = F.coalesce(F.to_json(F.try_parse_json(params)), params)
    return [F.sha2(F.concat_ws("|", scope, canonical), 256).alias("input_hash"), F.date_trunc("minute", anchor).alias("anchor_minute")]


def new_snapshots(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates whose key is not stored yet, one per key."""
    keys = ["input_hash", "anchor_minute"]
    return candidates.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
