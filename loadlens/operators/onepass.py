"""Several group-bys and the grand total of one source in one scan.

A report section groups the same rows by account, by report, by hour bucket and as a whole. ``GroupedPass`` collects
these wishes and answers them with one plan, grouping sets over the keys and the empty set:

    scan -> Generate (a row per set: its number and key) -> HashAggregate(partial) -> Exchange -> HashAggregate(final)

(Spark's own GROUPING SETS would do the same by Expand, but a second use of such a plan in one query, as the guards need
it, is not recognised as the held table.) The partial step combines map-side, so a hot key and the grand total ship one row per task each. The grouped table is
held (MEMORY_AND_DISK, computed at the first use, recomputed from the source if an executor is lost); every output
and every evidence guard is a filter on its set number. The size of what is held is that of the grouped keys, never of
the rows. ``release`` gives it back.

Null keys form no group (their rows still count in the grand total). An empty source has no groups and null totals.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.operators.aggregates import MetricSpec, metric_expr


class GroupedPass:
    """Declare groups with ``by`` and totals with ``total``; then read ``groups`` and ``positive``."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.keys: dict[str, Column] = {}
        self.metrics: dict[tuple[str, str], str] = {}
        self._held: DataFrame | None = None
        self._sums: Column | None = None

    def _metric(self, func: str, column: str) -> str:
        if self._held is not None:
            raise ValueError("declare all groups before the first is read")
        return self.metrics.setdefault((func.lower(), column), f"m{len(self.metrics)}")

    def by(self, name: str, metrics: Iterable[MetricSpec], key: Column | None = None) -> None:
        """Group by ``key`` (default: the column ``name``); the metrics' aliases are given when the groups are read."""
        if self._held is not None and name not in self.keys:
            raise ValueError("declare all groups before the first is read")
        self.keys[name] = F.col(name) if key is None else key
        for _, func, column in metrics:
            self._metric(func, column)

    def total(self, columns: Sequence[str]) -> None:
        """Sums over the whole source, of the columns that it has."""
        for c in columns:
            if c in self.df.columns:
                self._metric("sum", c)

    def _set_number(self, name: str | None) -> int:
        """The number of a key's set; the grand total comes last."""
        return len(self.keys) if name is None else list(self.keys).index(name)

    @property
    def held(self) -> DataFrame:
        """All sets: the keys k0.., the metrics m0.. and the set number."""
        if self._held is None:
            self._held = self._plan().persist(StorageLevel.MEMORY_AND_DISK)
        return self._held

    def _plan(self) -> DataFrame:
        columns = list(dict.fromkeys(c for _, c in self.metrics if c != "*"))
        place = {c: f"c{i}" for i, c in enumerate(columns)}
        keys = [f"k{i}" for i in range(len(self.keys))]
        rows = self.df.select(*[e.alias(k) for k, e in zip(keys, self.keys.values())],
                              *[F.col(f"`{c}`").alias(place[c]) for c in columns])
        aggs = [metric_expr(func, place.get(c, c), alias) for (func, c), alias in self.metrics.items()]
        if not keys:
            return rows.agg(*(aggs or [F.count(F.lit(1)).alias("n")])).withColumn("set", F.lit(0))
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        none = {k: F.lit(None).cast(kinds[k]).alias(k) for k in keys}
        sets = [F.struct(F.lit(i).alias("set"), *[F.col(k) if j == i else none[k] for j, k in enumerate(keys)])
                for i in range(len(keys) + 1)]
        laid = rows.select(*[F.col(c) for c in place.values()], F.inline(F.array(*sets)))
        own = [(F.col("set") == i) & F.col(k).isNotNull() for i, k in enumerate(keys)]
        wanted = F.col("set") == len(keys)
        for cond in own:
            wanted |= cond
        return laid.filter(wanted).groupBy("set", *keys).agg(*aggs)

    def groups(self, name: str, metrics: Sequence[MetricSpec], alias: str | None = None) -> DataFrame:
        """One row per non-null key: the key (named ``alias`` or ``name``) and the metrics under their aliases."""
        key = f"k{list(self.keys).index(name)}"
        return self.held.filter((F.col("set") == self._set_number(name)) & F.col(key).isNotNull()).select(
            F.col(key).alias(alias or name),
            *[F.col(self.metrics[func.lower(), column]).alias(out) for out, func, column in metrics])

    def totals(self) -> DataFrame:
        """The grand total as one row."""
        return self.held.filter(F.col("set") == self._set_number(None))

    def positive(self, columns: Sequence[str]) -> Column:
        """Evidence guard: the sums of these columns (of those the source has) are together > 0."""
        known = [self.metrics["sum", c] for c in columns if ("sum", c) in self.metrics]
        if not known:
            return F.lit(False)
        if self._sums is None:  # one scalar subquery for all guards
            sums = [m for (func, _), m in self.metrics.items() if func == "sum"]
            self._sums = self.totals().select(F.struct(*sums).alias("sums")).scalar()
        return sum((F.coalesce(self._sums[m].cast("double"), F.lit(0.0)) for m in known), F.lit(0.0)) > 0

    def release(self) -> None:
        if self._held is not None:
            self._held.unpersist()
