"""How many lists to probe and rows to scan, from table size, list sizes and past recall."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


# Fixed values: (rows from which, growth for each 100,000 rows beyond), the first that holds.
PROBE_GROWTH = ((100_000, 0.15), (50_000, 0.10), (20_000, 0.05))
MID_GROWTH = ((100_000, 0.05), (50_000, 0.03))
BUDGET_GROWTH = ((100_000, 0.15), (50_000, 0.12), (20_000, 0.08))


def growth(n: int, steps: tuple) -> float:
    return next((1 + (n - limit) / 100_000 * rate for limit, rate in steps if n > limit), 1.0)


def two_level_probe(base: int, n: int, mean_list: float, n_coarse: int, mid: bool = False) -> int:
    """Probes of the two-level search: grows with rows and list size, at most half of the coarse lists."""
    if n == 0:
        return base
    out = max(base, 3)
    if mid:
        return out
    out = int(out * growth(n, PROBE_GROWTH))
    if mean_list > 500:
        out = int(out * (1 + (mean_list - 500) / 2000 * 0.05))
    return min(out, max(3, int(0.5 * n_coarse)))


def single_level_probe(base: int, n: int, mean_list: float, lists: int, mid: bool = False) -> int:
    """Probes of the one-level search: a share of the lists between 5 % and 30 % (20 % if filtered midway), grown with list size and rows."""
    if n == 0:
        return base
    most = int(lists * (0.20 if mid else 0.30))
    out = min(max(base, 1, int(0.05 * lists)), most)
    by_size = 1 + max(0.0, mean_list - (1500 if mid else 500)) / (5000 if mid else 2000)
    for factor in (growth(n, MID_GROWTH), by_size) if mid else (by_size, growth(n, PROBE_GROWTH)):
        out = int(out * factor)
    return min(out, max(1, most))


def scan_budget(k: int, n: int, mid: bool = False, base: int = 0) -> int:
    """Rows to scan for k results: a floor by k or the given base, growth with the table, a cap."""
    floor = min(1.5 * k, 1500) if mid else 2.5 * k
    return max(1, min(int(max(base, floor) * growth(n, BUDGET_GROWTH)), 3000 if mid else 6000))


# Target recall and weight of speed of each preset; growth of probes and budgets; feedback of recall.
PRESETS = {"balanced": (0.5, 0.5), "recall": (0.7, 0.3), "speed": (0.4, 0.7)}
SIZE_LOG, LONG_LIST, PROBE_LIST, BUDGET_LIST, UNEVEN, UNEVEN_RATE = 20, 1000, 2000, 3000, 2.0, 0.1
FAR_BELOW, BELOW, MARGIN, HIGH = 2.0, 0.5, 0.1, 0.9
#: By whether recall is above HIGH: lowest factor, cut with and without a preference for speed, share of the probes' factor that counts.
ABOVE = {True: (0.5, 0.5, 0.3, 0.2), False: (0.8, 0.3, 0.15, 0.5)}


@dataclass
class Controller:
    """Probe and budget for each query batch, with feedback from measured recall and speed. Values are cut to integers after each factor."""

    base_probe: int = 10
    min_probe: int = 10
    max_probe: int = 10
    base_budget: int = 5000
    min_budget: int = 2000
    max_budget: int = 5000
    target_recall: float = 0.5
    min_recall: float = 0.3
    speed_weight: float = 0.5
    first_size: int = 10_000
    recalls: list = field(default_factory=list)
    speeds: list = field(default_factory=list)
    probes: list = field(default_factory=list)
    budgets: list = field(default_factory=list)

    @classmethod
    def preset(cls, name: str, **options) -> Controller:
        target, speed = PRESETS[name]
        return cls(**({"target_recall": target, "speed_weight": speed} | options))

    def probe(self, n: int, mean_list: float, max_list: float) -> int:
        factors = []
        if n > self.first_size:
            factors.append(1 + math.log(n / self.first_size) / math.log(SIZE_LOG))
        if mean_list > LONG_LIST:
            factors.append(1 + (mean_list - LONG_LIST) / PROBE_LIST)
        if mean_list > 0 and max_list / mean_list > UNEVEN:
            factors.append(1 + UNEVEN_RATE * (max_list / mean_list - UNEVEN))
        x = self.base_probe
        for f in factors:
            x = int(x * f)
        return max(self.min_probe, min(x, self.max_probe))

    def feedback(self, recall: float | None) -> tuple[float, float]:
        """The budget's factor by recall, and the share of the probes' growth that counts."""
        if recall is None:
            return 1.0, 1.0
        if recall < self.min_recall:
            return 1 + FAR_BELOW * (self.min_recall - recall), 1.0
        if recall < self.target_recall:
            return 1 + BELOW * (self.target_recall - recall), 1.0
        if recall <= self.target_recall + MARGIN:
            return 1.0, 1.0
        least, fast, fair, share = ABOVE[recall > HIGH]
        cut = 0.0 if self.speed_weight < 0.5 else fast if self.speed_weight > 0.5 else fair
        return (max(least, 1 - cut * (recall - self.target_recall - MARGIN)) if cut else 1.0), share

    def budget(self, probe: int, mean_list: float, recall: float | None = None) -> int:
        by_recall, share = self.feedback(recall)
        long = 1 + max(0.0, mean_list - LONG_LIST) / BUDGET_LIST
        x = self.base_budget
        for f in (1 + (probe / self.base_probe - 1) * share, by_recall, long):
            x = int(x * f)
        return max(self.min_budget, min(x, self.max_budget))

    def next(self, n: int, mean_list: float, max_list: float) -> tuple[int, int]:
        probe = self.probe(n, mean_list, max_list)
        budget = self.budget(probe, mean_list, self.recalls[-1] if self.recalls else None)
        self.probes.append(probe)
        self.budgets.append(budget)
        return probe, budget

    def observe(self, recall: float, speed: float) -> None:
        self.recalls.append(recall)
        self.speeds.append(speed)

    def set_weights(self, speed_weight: float) -> None:
        self.speed_weight = min(1.0, max(0.0, speed_weight))

    def summary(self) -> dict:
        said = {}
        for name in ("recalls", "speeds", "probes", "budgets"):
            x = getattr(self, name)
            said[name] = {"count": len(x)} | ({"avg": sum(x) / len(x), "min": min(x), "max": max(x)} if x else {})
        return said

    def reset(self) -> None:
        for name in ("recalls", "speeds", "probes", "budgets"):
            getattr(self, name).clear()


def table(spark: SparkSession, n: int, mean_list: float, max_list: float, recalls: tuple = (None,), **options) -> DataFrame:
    """Probes and budgets of each preset, for each of the recalls that may have been measured last."""
    rows = []
    for name in PRESETS:
        for recall in recalls:
            c = Controller.preset(name, **options)
            if recall is not None:
                c.observe(recall, 0.0)
            probe, budget = c.next(n, mean_list, max_list)
            rows.append((name, recall, probe, budget))
    return spark.createDataFrame(rows, "preset string, recall double, n_probe int, budget int")


def rules(spark: SparkSession, sizes: tuple, means: tuple, base: int = 8, k: int = 100, lists: int = 200, n_coarse: int = 64) -> DataFrame:
    """Probes and budgets by table size and mean list size."""
    rows = [(n, m, two_level_probe(base, n, m, n_coarse), single_level_probe(base, n, m, lists), single_level_probe(base, n, m, lists, True), scan_budget(k, n), scan_budget(k, n, True)) for n in sizes for m in means]
    return spark.createDataFrame(rows, "n long, mean_list double, two_level int, single_level int, single_mid int, budget int, budget_mid int")
