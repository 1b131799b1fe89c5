"""Equi-join fused with SUM(probe payload): hash joins under a choice of scheme and execution strategy.

Build and probe sides have columns key and value. Null keys never match. An empty result sums to 0. Strategy names the
physical join; the sum is computed partially beside the probe, so joined rows are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.storagelevel import StorageLevel

from tessera.functions.radix import RadixBits


class HashingScheme(Enum):
    """perfect: unique build keys, at most one match. The others keep duplicates, each match counting."""

    PERFECT = "perfect"
    LINEAR_PROBING = "linear_probing"
    BUCKET_CHAINING = "bucket_chaining"


class Strategy(Enum):
    """Where the build side goes. auto lets Spark decide by size; the names of heterogeneous executions map to these."""

    AUTO = "auto"
    BROADCAST = "broadcast"
    SHUFFLE_HASH = "shuffle_hash"
    SORT_MERGE = "merge"


#: Execution methods by name, and the plan that each becomes on Spark's executors.
EXECUTION_METHODS = {
    "cpu": Strategy.BROADCAST,
    "gpu": Strategy.AUTO,
    "gpu_stream": Strategy.AUTO,
    "gpu_stream_unified": Strategy.AUTO,
    "het": Strategy.BROADCAST,
    "gpu_build_het_probe": Strategy.BROADCAST,
}

#: Two-pass radix joins by name, and how their rows are placed (see radix_join_sum).
RADIX_METHODS = {
    "cpu_partitioned_radix_two_pass": "first_pass",
    "gpu_radix_two_pass": "hash",
    "out_of_core_radix_two_pass": "first_pass_sorted",
}

#: Build sides over so many rows are not broadcast even if asked for (24 bytes a row in the hash relation, 48 MB).
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class HashJoin:
    """Settings of a join; `with_` gives a changed copy.

    selective says that build keys may be null, which leaves them out. Unset, a null build key matches nothing either,
    but validate then raises on it, as it does on duplicate keys of the perfect scheme.
    """

    scheme: HashingScheme = HashingScheme.LINEAR_PROBING
    selective: bool = False
    strategy: Strategy = Strategy.AUTO
    validate: bool = False
    broadcast_rows: int = BROADCAST_ROWS

    def with_(self, **changes) -> HashJoin:
        return replace(self, **changes)

    def table_length(self, rows: int) -> int:
        """Slots that the scheme's hash table would have; a derived figure, Spark sizes its own relations."""
        if self.scheme is HashingScheme.PERFECT:
            return rows
        return 2 * (1 << max(0, (max(rows, 1) - 1).bit_length()))

    def build(self, build: DataFrame) -> DataFrame:
        """The build side as the scheme holds it: no null keys. With validate, what the settings exclude raises."""
        if self.validate and not self.selective and not build.filter(F.col("key").isNull()).isEmpty():
            raise ValueError("null build keys need a selective join")
        build = build.filter(F.col("key").isNotNull())
        if self.scheme is HashingScheme.PERFECT and self.validate and not build.groupBy("key").count().filter("count > 1").isEmpty():
            raise ValueError("the perfect scheme needs unique build keys")
        return build

    def table(self, build: DataFrame) -> HashTable:
        """A build side that several probes use: it is read and filtered once. `free` it after the last of them."""
        return HashTable(self, self.build(build).select("key").persist(StorageLevel.MEMORY_AND_DISK))

    def _hinted(self, build: DataFrame) -> DataFrame:
        if self.strategy is Strategy.AUTO:
            return build
        if self.strategy is Strategy.BROADCAST and build.count() > self.broadcast_rows:
            return build.hint("shuffle_hash")
        return build.hint(self.strategy.value)

    def probe_sum(self, build: DataFrame, probe: DataFrame) -> DataFrame:
        """One row: probe_sum, the sum of probe values over all matches."""
        return self._sum(self._hinted(self.build(build).select("key")), probe)

    def _sum(self, keys: DataFrame, probe: DataFrame) -> DataFrame:
        how = "left_semi" if self.scheme is HashingScheme.PERFECT else "inner"
        joined = probe.select("key", "value").join(keys, "key", how)
        return joined.agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("probe_sum"))


@dataclass(frozen=True)
class HashTable:
    """A persisted build side; `copy` gives one for other settings over the same rows."""

    join: HashJoin
    keys: DataFrame

    def probe_sum(self, probe: DataFrame) -> DataFrame:
        return self.join._sum(self.join._hinted(self.keys), probe)

    def copy(self, **changes) -> HashTable:
        return HashTable(self.join.with_(**changes), self.keys)

    def free(self) -> None:
        self.keys.unpersist()


def radix_join_sum(build: DataFrame, probe: DataFrame, bits: RadixBits, scheme: HashingScheme = HashingScheme.PERFECT, placement: str = "hash") -> DataFrame:
    """probe_sum over a join of radix partitions, whose ids are part of the join condition: one exchange a side.

    placement says how rows reach their tasks:
    hash: Spark's exchange over key and id, which spreads skewed low bits and which adaptive execution can split;
    by_id: task k gets exactly radix id k of all passes, so tasks equal the fanout and a hot id stays whole;
    first_pass: task k gets id k of the first pass, and hashes the second pass's partitions in it;
    first_pass_sorted: the same, but the second pass orders a task's rows by its id and key and the join merges them,
    so a partition larger than memory spills instead of failing.
    """
    how = "left_semi" if scheme is HashingScheme.PERFECT else "inner"
    ids = [f"p{k}" for k in range(1, len(bits.passes) + 1)]

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.filter(F.col("key").isNotNull())
        if placement in ("hash", "by_id"):
            rows = rows.withColumn("pid", bits.combined_id(F.col("key")).cast("int"))
            return rows if placement == "hash" else rows.repartitionById(bits.fanout(), "pid")
        for k, name in enumerate(ids, 1):
            rows = rows.withColumn(name, bits.partition_id(F.col("key"), k).cast("int"))
        rows = rows.repartitionById(bits.fanout(1), "p1")
        return rows.sortWithinPartitions(*ids, "key") if placement == "first_pass_sorted" else rows

    if placement not in ("hash", "by_id", "first_pass", "first_pass_sorted"):
        raise ValueError(f"unknown placement {placement!r}")
    on = ["pid", "key"] if placement in ("hash", "by_id") else [*ids, "key"]
    right = placed(build.select("key")).hint("merge" if placement == "first_pass_sorted" else "shuffle_hash")
    joined = placed(probe.select("key", "value")).join(right, on, how)
    return joined.agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("probe_sum"))
