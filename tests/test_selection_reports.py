"""Reports of many selections from one table of facts: brute force, overlaps, repeats, unknown names, empty selections, plan."""

import json
import random
from collections import Counter

import pytest

from fleetlens.functions.exprs import timestamp
from fleetlens.operators import selection_reports as M

INV = ("server_id bigint, hostname string, public_id string, cpu_cores int, mem_total_bytes bigint, "
       "net_interfaces array<struct<addresses:array<struct<address:string>>>>")
ROWS = ("server_id bigint, classification string, causes array<string>, risk_level string, risk_rank int, cpu_p95 double, "
        "mem_p95 double, runway_days double, driving_mount string")
CLASSES = [("under_provisioned", "high", 0), ("idle", "attention", 1), ("over_provisioned", "attention", 1), ("optimal", "normal", 2)]


@pytest.fixture(scope="module")
def data(spark):
    rng, inv, rows = random.Random(11), [], []
    for i in range(1, 41):
        net = [([(f"10.0.0.{i}",), (f"10.1.0.{i % 5}",)],)] if i % 7 else None
        inv.append((i, None if i == 40 else f"h{i // 2}", f"p{i}", i % 6, 100 * i, net))
        if i < 36:  # the last hosts are not assessed
            cls, risk, rank = rng.choice(CLASSES)
            rows.append((i, cls, [rng.choice(["cpu_util", "mem_util"]), None], risk, rank, rng.choice([None, float(i % 9)]), 5.0, rng.choice([None, 3.0, 90.0]), rng.choice([None, "/"])))
    support = [(i, ["supported", None, "ended"][i % 3]) for i in range(1, 38)]
    signals = [(i, k, "x") for i in range(1, 20) for k in ("gap", "os_eol", "gap")[: i % 4]]
    tokens = [("names", "hostname", f"h{n}") for n in (1, 2, 2, 99)] + [("nets", "ip", "10.1.0.3"), ("nets", "pair", "h4~10.0.0.8"), ("nets", "pair", "h4~p9"),
              ("ids", "public_id", "p40"), ("ids", "public_id", "p1"), ("nobody", "hostname", "none"), ("nobody", "hostname", None)]
    return inv, rows, support, signals, tokens


def frames(spark, data):
    inv, rows, support, signals, tokens = data
    inventory = spark.createDataFrame(inv, INV)
    facts = M.host_facts(inventory, spark.createDataFrame(rows, ROWS), spark.createDataFrame(support, "server_id bigint, support string"),
                         spark.createDataFrame(signals, "server_id bigint, kind string, detail string"))
    tok = spark.createDataFrame(tokens, "selection string, kind string, token string")
    return inventory, facts, tok, M.selection_members(inventory, tok)


def brute(data):
    inv, rows, support, signals, tokens = data
    names = {}
    for i, host, pid, _, _, net in inv:
        ips = [a[0] for n in (net or []) for a in n[0]]
        own = {("hostname", host), ("public_id", pid)} | {("ip", a) for a in ips}
        names[i] = {t for t in own if t[1]} | ({("pair", f"{host}~{x}") for x in [pid, *ips]} if host else set())
    members = {(s, i) for s, k, t in tokens for i in names if (k, t) in names[i]} | {("*", i[0]) for i in inv}
    known = set().union(*names.values())
    by, sup, sig = {r[0]: r for r in rows}, dict(support), {(i, k) for i, k, _ in signals}
    counts = Counter()
    for s, i in members:
        r = by.get(i)
        found = [f"support:{sup.get(i)}"] * bool(sup.get(i)) + [f"attention:{k}" for j, k in sig if j == i]
        if r:
            found += [f"class:{r[1]}"] + [f"cause:{c}" for c in r[2] if c and r[1] == "under_provisioned"]
            found += ["imminent"] * (r[7] is not None and r[7] < 30 and r[8] is not None)
        counts.update((s, f) for f in found)
    return members, counts, known, by


def test_sections_equal_brute_force(spark, data):
    _, facts, _, members = frames(spark, data)
    want, counts, _, _ = brute(data)
    assert {tuple(r) for r in members.collect()} == {m for m in want if m[0] != "*"}
    assert {(r.selection, r.section): r.hosts for r in M.section_counts(facts, members).collect()} == dict(counts)


def test_summary_and_top_equal_brute_force(spark, data):
    inventory, facts, tok, members = frames(spark, data)
    want, _, known, by = brute(data)
    cores = {i[0]: i[3] for i in data[0]}
    got = {r.selection: r for r in M.selection_summary(facts, members, M.selection_tokens(inventory, tok)).collect()}
    asked = {s: {(k, t) for x, k, t in data[4] if x == s} for s in {t[0] for t in data[4]}}
    assert set(got) == {"*", *asked}
    for s, r in got.items():
        ids = [i for x, i in want if x == s]
        assert (r.hosts, r.cpu_cores) == (len(ids), sum(cores[i] for i in ids) if ids else None)
        assert (r.tokens, r.unmatched) == (len(asked.get(s, ())), len(asked.get(s, set()) - known))
        assert r.under_count == sum(by[i][1] == "under_provisioned" for i in ids if i in by)
    assert got["nobody"].hosts == 0 and got["nobody"].unmatched == 2
    host = {i[0]: i[1] for i in data[0]}
    top = sorted((r.selection, r.place, r.server_id) for r in M.top_hosts(facts, members, 4).collect())

    def rank(i):
        r = by.get(i)
        return (r[4] if r else 9, -((r[5] or 0.0) if r else 0.0), host[i] or "", i)

    assert top == sorted((s, p + 1, i) for s in {m[0] for m in want} for p, i in enumerate(sorted([i for x, i in want if x == s], key=rank)[:4]))


def test_envelopes_name_filters_warnings_and_servers(spark, data, tmp_path):
    inventory, _, tok, members = frames(spark, data)
    rows = spark.createDataFrame(data[1], ROWS)
    tok = tok.unionByName(spark.createDataFrame([("names", "hostname", " h1 "), ("names", "ip", "  ")], tok.schema))
    end = timestamp("2024-02-01 00:00:00")
    out = M.assessment_envelopes(rows, inventory, members, tok, 14, end, end).cache()
    heads = {r.selection: json.loads(r.document) for r in out.where("part = 'envelope'").collect()}
    want, _, known, by = brute(data)
    assert set(heads) == {"*", "names", "nets", "ids", "nobody"}
    assert heads["names"]["filter"] == {"hostname": ["h1", "h2", "h99"], "ip": [], "public_id": [], "pair": []}
    assert heads["names"]["warnings"] == {"ambiguous_hostnames": ["h1", "h2"], "unresolved_pairs": [], "unmatched_filters": ["h99"]}
    assert heads["nets"]["warnings"]["unresolved_pairs"] == sorted(t for s, k, t in data[4] if k == "pair" and (k, t) not in known)
    assert heads["*"]["window"]["days"] == 14 and heads["*"]["window"]["start"].startswith("2024-01-18") and heads["*"]["contract_version"] == "1.0"
    for s, h in heads.items():
        ids = sorted(i for x, i in want if x == s and i in by)
        assert h["count"] == len(ids)
        assert sorted(r.server_id for r in out.where((out.selection == s) & (out.part == "server")).collect()) == ids
    M.write_envelopes(out, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert back.count() == out.count() and {json.loads(r.value)["count"] for r in back.where("part = 'envelope' and selection = '*'").collect()} == {len(by)}


def test_empty_tables(spark, data):
    inventory, facts, tok, members = frames(spark, ([], [], [], [], data[4]))
    assert M.section_counts(facts, members).count() == 0 and M.top_hosts(facts, members, 3).count() == 0
    assert {r.selection: r.unmatched for r in M.selection_summary(facts, members, M.selection_tokens(inventory, tok)).collect()} == {"names": 3, "nets": 3, "ids": 2, "nobody": 2}


def test_number_of_selections_does_not_change_the_plan(spark, data, tmp_path):
    inventory, facts, tok, _ = frames(spark, data)
    facts.write.parquet(str(tmp_path / "facts"))
    inventory.write.parquet(str(tmp_path / "inventory"))
    facts, inventory = (spark.read.parquet(str(tmp_path / n)) for n in ("facts", "inventory"))
    plan = M.section_counts(facts, M.selection_members(inventory, tok))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4  # facts for selections and whole fleet, names and addresses of the inventory


def test_envelopes_collect_no_side_of_a_join(spark, data, tmp_path):
    """The files of a fleet's documents are small, its documents are not: they must not pass through the driver."""
    inventory, _, tok, _ = frames(spark, data)
    rows = spark.createDataFrame(data[1], ROWS)
    for name, df in (("rows", rows), ("inventory", inventory), ("tokens", tok)):
        df.write.parquet(str(tmp_path / name))
    rows, inventory, tok = (spark.read.parquet(str(tmp_path / n)) for n in ("rows", "inventory", "tokens"))
    end = timestamp("2024-02-01 00:00:00")
    out = M.assessment_envelopes(rows, inventory, M.selection_members(inventory, tok), tok, 14, end, end)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_assessed_rows_are_built_without_broadcasts(spark, monkeypatch):
    from fleetlens.workload import q_fleet as Q
    from fleetlens.workload.registry import Context

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    monkeypatch.setattr(Q, "_written", lambda c, name, build: spark.conf.get(key))
    assert Q.assessed_rows(Context(spark, "none")) == "-1" and spark.conf.get(key) == before != "-1"
