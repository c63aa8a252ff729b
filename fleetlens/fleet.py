"""The set of telemetry tables an analysis reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

TABLES = ("inventory", "inventory_history", "host_metrics", "disk_io", "net_io", "filesystem", "cpu_core", "pressure",
          "disk_error", "tasks", "report_jobs")


@dataclass
class Fleet:
    """Lazy access to the tables by name: ``fleet["disk_io"]``. Each table is resolved once."""

    load: Callable[[str], DataFrame]
    _seen: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = self.load(name)
        return self._seen[name]

    def select_hosts(self, hosts: DataFrame) -> Fleet:
        """The same fleet restricted to the ``server_id`` values of ``hosts``, before any aggregate runs."""
        ids = hosts.select("server_id").distinct()
        return Fleet(lambda n: self[n].join(ids, "server_id", "left_semi"))

    @classmethod
    def from_parquet(cls, spark, root: str, start: Column | None = None, end: Column | None = None) -> Fleet:
        """Tables stored below ``root`` by ``sources.tables``; a range prunes the day folders of the time series."""
        from fleetlens.sources.tables import read_table

        return cls(lambda n: read_table(spark, root, n, start, end))
