"""Session options of the symbolic front end. A mode never changes an answer; those that differ from the default map to Spark options.

`evaluate` plans a query in a session of its own with these options, so they last as long as the query and touch no other.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: The names each mode option takes; the first is the default.
MODES = {
    "SelectMode": ("Adaptive", "Branch", "Predication", "AdaptiveParallel"),
    "PartitionMode": ("RadixBitsAdaptiveParallel", "RadixBitsAdaptive", "RadixBitsFixedMin", "RadixBitsFixedMax"),
    "GroupMode": ("GroupAdaptiveParallel", "GroupAdaptive", "Hash", "Sort"),
}
LABEL = {"SelectMode": "select", "PartitionMode": "partition", "GroupMode": "group"}
#: Bytes taken for a row when a tuple count is turned into a partition size.
ROW_BYTES = 64


@dataclass
class Settings:
    options: dict[str, Any] = field(
        default_factory=lambda: {**{k: v[0] for k, v in MODES.items()}, "DeferGatherPhase": False, "RadixJoinMinPartitionSize": 300_000, "Parallel": 1}
    )

    def knows(self, name: str) -> bool:
        return name in self.options or name == "CachedColumn"

    def put(self, name: str, value: Any) -> bool:
        """Check and record one option; True when done."""
        value = getattr(value, "name", value)
        if name in MODES:
            if value not in MODES[name]:
                raise ValueError(f"unknown {LABEL[name]} mode: {value}")
        elif name == "DeferGatherPhase":
            if not isinstance(value, bool):
                raise ValueError("DeferGatherPhase must be True or False")
        elif name == "RadixJoinMinPartitionSize":
            if not isinstance(value, int) or isinstance(value, bool) or value < 0:
                raise ValueError("RadixJoinMinPartitionSize must be a count of rows")
        elif name == "CachedColumn":
            return True
        self.options[name] = value
        return True

    def with_parallel(self, n: int) -> Settings:
        return Settings({**self.options, "Parallel": n})

    def spark_conf(self) -> dict[str, str]:
        """Spark options that stand for what differs from the defaults."""
        default, conf = Settings().options, {}
        if "Fixed" in self.options["PartitionMode"]:  # as many parts as there are, whatever their size
            conf["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
        if self.options["RadixJoinMinPartitionSize"] != default["RadixJoinMinPartitionSize"]:
            conf["spark.sql.adaptive.coalescePartitions.minPartitionSize"] = str(max(1, self.options["RadixJoinMinPartitionSize"] * ROW_BYTES))
        if self.options["GroupMode"] == "Sort":  # rows sorted by key stay sorted up to the group, which then needs no hash table
            conf["spark.sql.execution.replaceHashWithSortAgg"] = "true"
            conf["spark.sql.optimizer.excludedRules"] = "org.apache.spark.sql.catalyst.optimizer.EliminateSorts"
        if self.options["Parallel"] > 1:
            conf["spark.sql.shuffle.partitions"] = str(self.options["Parallel"])
            conf["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
        return conf
