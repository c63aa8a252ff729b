"""Task log: effective results, deadlines, newest task per host, paging through the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.kernels import latest_one

# Exit codes that mean success although the script reports failure, by build, OS family or id:major.
SUCCESS_EXIT_CODES = {"windows": [2], "rocky:9": [3], "almalinux:9": [3], "ol:9": [3], "centos:9": [3]}


def allowed_exit(code: Column, os_family: Column, os_id: Column, os_version: Column,
                 allow: dict[str, list[int]] = SUCCESS_EXIT_CODES) -> Column:
    """Is the exit code allowed for the build, else for the family (Windows), or for ``id:major`` (Linux)?"""
    table = F.create_map(*[x for k, v in allow.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    major = F.concat(os_id, F.lit(":"), F.split_part(os_version, F.lit("."), F.lit(1)))

    def hit(key: Column) -> Column:
        return F.coalesce(F.array_contains(F.try_element_at(table, key), code), F.lit(False))

    return F.when(os_family == "windows", hit(os_version) | hit(F.lit("windows"))).when(
        os_family == "linux", hit(major)).otherwise(False)


def effective_status(tasks: DataFrame, allow: dict[str, list[int]] = SUCCESS_EXIT_CODES) -> DataFrame:
    """Adds ``eff_status`` and ``eff_reason``: the reported policy flag decides first, then the exit code list."""
    c = F.col
    ok = ((c("status") == "failure") & (c("failure_reason") == "script_failed") & c("exit_code").isNotNull()
          & allowed_exit(c("exit_code"), c("os_family"), c("os_id"), c("os_version"), allow))
    done = F.coalesce(c("task_policy"), F.lit(False)) | (c("task_policy").isNull() & F.coalesce(ok, F.lit(False)))
    broken = ~F.coalesce(c("task_policy"), F.lit(True))
    return tasks.withColumns({
        "eff_status": F.when(done, "success").when(broken, "failure").otherwise(c("status")),
        "eff_reason": F.when(done, None).when(broken, F.coalesce(c("failure_reason"), F.lit("install_unverified"))).otherwise(c("failure_reason"))})


def overdue(now: Column) -> Column:
    return F.coalesce((F.col("status") == "pending") & (F.col("deadline_at") < now), F.lit(False))


def displayed_status(tasks: DataFrame, now: Column) -> DataFrame:
    """A pending task past its deadline shows as a timeout before it is expired in storage."""
    late = overdue(now) | (F.col("failure_reason") == "timeout")
    return tasks.withColumns({"shown_status": F.when(late, "failure").otherwise(F.col("status")),
                              "shown_reason": F.when(late, "timeout").otherwise(F.col("failure_reason"))})


def expire_overdue(tasks: DataFrame, now: Column) -> DataFrame:
    """The task table after expiry."""
    late = overdue(now)
    return tasks.withColumns({"failure_reason": F.when(late, "timeout").otherwise(F.col("failure_reason")),
                              "completed_at": F.when(late, now), "status": F.when(late, "failure").otherwise(F.col("status"))})


def pending_servers(tasks: DataFrame) -> DataFrame:
    """Hosts with a pending task that has a deadline; to be read after ``expire_overdue``."""
    return tasks.filter((F.col("status") == "pending") & F.col("deadline_at").isNotNull()).select("server_id").distinct()


def latest_tasks(tasks: DataFrame) -> DataFrame:
    return latest_one(tasks, ["server_id"], [F.desc("created_at"), F.desc("task_id")])


def recent_tasks(tasks: DataFrame, limit: int, cursor: Column | None = None) -> DataFrame:
    """Newest tasks before the cursor; ties by id."""
    df = tasks if cursor is None else tasks.filter(F.col("created_at") < cursor)
    return df.orderBy(F.desc("created_at"), F.desc("task_id")).limit(limit)


def with_inventory(tasks: DataFrame, inventory: DataFrame) -> DataFrame:
    """Tasks with the facts of their host; tasks of unknown hosts stay."""
    return tasks.join(inventory.select("server_id", "hostname", "os_family", "os_id", "os_version"), "server_id", "left")


def apply_results(tasks: DataFrame, results: DataFrame, allow: dict[str, list[int]] = SUCCESS_EXIT_CODES) -> DataFrame:
    """Tasks updated from result messages: the newest result per task id wins, results of unknown ids are dropped."""
    newest = latest_one(results, ["task_id"], [F.desc("completed_at"), F.desc("message_id")])
    eff = effective_status(newest, allow).select(
        "task_id", F.col("eff_status").alias("_s"), F.col("eff_reason").alias("_r"), F.col("exit_code").alias("_x"),
        F.col("completed_at").alias("_at"))
    j = tasks.join(eff, "task_id", "left")
    hit = F.col("_s").isNotNull()
    return j.withColumns({
        "failure_reason": F.when(hit, F.col("_r")).otherwise(F.col("failure_reason")),
        "exit_code": F.when(hit, F.col("_x")).otherwise(F.col("exit_code")),
        "completed_at": F.when(hit, F.col("_at")), "status": F.when(hit, F.col("_s")).otherwise(F.col("status")),
    }).drop("_s", "_r", "_x", "_at")
