"""Right-sizing rules: cases with known answers and invariants over generated hosts."""

import random

import pytest

from fleetlens.functions import rules as R

COLS = ", ".join(f"{n} {t}" for n, t in R.STAT_TYPES.items())


def assess(spark, *hosts):
    rows = [(i, *[h.get(n) for n in R.STAT_TYPES]) for i, h in enumerate(hosts)]
    return R.assess_host(spark.createDataFrame(rows, "id int, " + COLS)).orderBy("id").collect()


def host(**kw):
    return {"os_family": "linux", "cpu_cores": 4, "mem_total_mb": 8192, "swap_paging": False, "oom_occurred": False, **kw}


def test_cpu_cases(spark):
    r = assess(spark, host(cpu_p95=90.0, cpu_cores=8, run_queue_p95=1.0), host(cpu_p95=40.0, run_queue_p95=8.0), host(cpu_p95=75.0, run_queue_p95=8.0),
               host(cpu_p95=10.0, cpu_cores=8), host(cpu_p95=10.0, cpu_cores=8, percore_p95_max=90.0), host(cpu_p95=65.0, cpu_cores=8, run_queue_p95=4.0),
               host(), host(cpu_p95=50.0, cpu_cores=None), host(run_queue_p95=9.0), host(cpu_p95=70.0, cpu_cores=4, run_queue_p95=0.0))
    assert [(x.cpu_status, x.cpu_target) for x in r[:6]] == [("under", 11), ("over", 3), ("under", 12), ("over", 2), ("optimal", 8), ("optimal", 8)]
    assert [x.cpu_status for x in r[6:9]] == ["unmeasured", "unmeasured", "under"]
    assert (r[9].cpu_status, r[9].cpu_target, r[9].cpu_floor) == ("under", None, 5)


def test_memory_cases(spark):
    r = assess(spark, host(mem_p95=95.0, mem_near_peak=96.0), host(mem_p95=40.0, mem_near_peak=40.0), host(mem_p95=80.0, mem_near_peak=80.0),
               host(oom_occurred=True), host(), host(mem_p95=95.0, mem_near_peak=60.0), host(mem_p95=92.0, mem_near_peak=50.0, swap_paging=True))
    assert [(x.mem_status, x.mem_target, x.mem_floor) for x in r] == [
        ("under", 9831, None), ("over", 4096, None), ("optimal", 8192, None), ("under", None, 10650), ("unmeasured", None, None), ("under", None, 10650), ("under", 10650, None)]
    assert r[6].mem_triggers == ["mem_util", "mem_saturation"]


def test_disk_io_and_network_cases(spark):
    r = assess(spark, host(runway_days=10.0, target_gb=50.0), host(runway_days=40.0, inode_runway_days=5.0, target_gb=50.0), host(disk_used_pct=90.0, target_gb=0.5),
               host(disk_used_pct=50.0), host(await_p95_ms=20.0, net_kbps=5.0, retrans_pct=9.0), host(await_p95_ms=21.0, net_kbps=50.0, retrans_pct=9.0), host(os_family="windows", disk_queue_p95=2.0, conntrack_ratio=0.8), host(disk_iops=3))
    assert [(x.disk_status, x.disk_target) for x in r[:5]] == [("filling", 50), ("filling", None), ("filling", None), ("capacity_ok", None), ("unmeasured", None)]
    assert [x.io_status for x in r[4:]] == ["io_ok", "io_bound", "io_bound", "io_ok"]
    assert [x.net_status for x in r[4:7]] == ["quality_ok", "congested", "congested"]


def test_host_status_and_root_cause(spark):
    r = assess(spark, host(cpu_p95=80.0, mem_p95=95.0, swap_paging=True, await_p95_ms=30.0), host(cpu_p95=80.0, mem_p95=50.0, await_p95_ms=30.0, blocked_p95=1.0),
               host(cpu_p95=2.0, mem_p95=85.0, net_kbps=100.0), host(cpu_p95=2.0, mem_p95=85.0, net_kbps=100.0, disk_iops=9), host())
    assert [(x.host_status, x.root_cause) for x in r] == [("under", "memory"), ("under", "disk_io"), ("idle", None), ("over", None), ("insufficient", None)]
    assert r[0].symptoms == ["disk_io", "cpu"] and r[1].symptoms == ["cpu"]


def test_downsize_needs_confidence(spark):
    good = dict(cpu_p95=10.0, run_queue_p95=1.0, mem_p95=50.0, mem_near_peak=50.0, history_hours=300.0, burst_ratio=1.0, sufficiency=0.9, trend_rising=False)
    r = assess(spark, host(**good), host(**{**good, "history_hours": 20.0}), host(**{**good, "sufficiency": 0.5}), host(**{**good, "trend_rising": True}), host(**{**good, "steal_p95": 9.0}))
    assert [x.cpu_downsize for x in r] == [True, False, False, False, False]
    assert [x.mem_downsize for x in r] == [True, False, False, False, True]


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(11)

    def maybe(f):
        return None if rng.random() < 0.15 else f()

    pct, flag = (lambda: rng.uniform(0, 100)), (lambda: rng.random() < 0.3)
    hosts = [dict(os_family=rng.choice(["linux", "windows", None]), cpu_cores=maybe(lambda: rng.randrange(0, 65)), cpu_p95=maybe(pct), cpu_peak=maybe(pct), mem_p95=maybe(pct),
                  mem_near_peak=maybe(pct), disk_used_pct=maybe(pct), net_kbps=maybe(lambda: rng.uniform(0, 500)), sufficiency=maybe(rng.random), run_queue_p95=maybe(lambda: rng.uniform(0, 100)),
                  pages_in_p95=maybe(lambda: rng.uniform(0, 40)), percore_p95_max=maybe(pct), blocked_p95=maybe(lambda: rng.uniform(0, 3)), oom_occurred=flag(), swap_paging=flag(),
                  mem_total_mb=maybe(lambda: rng.randrange(512, 262144)), await_p95_ms=maybe(lambda: rng.uniform(0, 60)), runway_days=maybe(lambda: float(rng.randrange(0, 400))),
                  inode_runway_days=maybe(lambda: float(rng.randrange(0, 400))), inode_used_pct=maybe(pct), target_gb=maybe(lambda: rng.uniform(0, 4000)), retrans_pct=maybe(lambda: rng.uniform(0, 3)),
                  drop_pct=maybe(lambda: rng.uniform(0, 1)), conntrack_ratio=maybe(rng.random), history_hours=maybe(lambda: rng.uniform(0, 336)), burst_ratio=maybe(lambda: rng.uniform(1, 4)),
                  trend_rising=maybe(flag), steal_p95=maybe(lambda: rng.uniform(0, 10))) for _ in range(2000)]
    return hosts, assess(spark, *hosts)


def test_invariants(many):
    hosts, rows = many
    for h, r in zip(hosts, rows):
        assert r.host_status in R.STATUS_CLASS and r.classification == R.STATUS_CLASS[r.host_status]
        assert (r.host_status == "under") == bool(r.under_kinds)
        if r.cpu_status == "under":
            assert (r.cpu_target is None) != (r.cpu_floor is None)
            assert (r.cpu_target or r.cpu_floor) > h["cpu_cores"]
        if r.cpu_status == "over":
            assert 1 <= r.cpu_target < h["cpu_cores"]
        if r.mem_status == "under" and h["mem_total_mb"]:
            assert (r.mem_target or r.mem_floor) > h["mem_total_mb"]
        if r.mem_status == "over":
            assert r.mem_target < h["mem_total_mb"]
        assert not (r.cpu_downsize and r.cpu_status != "over")
        if r.root_cause is not None:
            assert r.root_cause in ("memory", "cpu", "disk_io", "disk_capacity")


def test_same_input_gives_same_output(spark, many):
    hosts, rows = many
    again = assess(spark, *hosts[:100])
    assert [r.asDict() for r in again] == [r.asDict() for r in rows[:100]]
