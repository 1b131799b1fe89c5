"""Hash-join and radix-join queries over the order and line tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.radix import RadixBits
from tessera.operators.hash_join import EXECUTION_METHODS, RADIX_METHODS, HashingScheme, HashJoin, Strategy, radix_join_sum
from tessera.session import table

_PERFECT, _LP, _CHAIN = HashingScheme.PERFECT, HashingScheme.LINEAR_PROBING, HashingScheme.BUCKET_CHAINING


def _orders(spark, sf_dir, key="o_orderkey"):
    return table(spark, sf_dir, "orders").select(F.expr(key).alias("key"))


def _lines(spark, sf_dir, key="l_orderkey"):
    return table(spark, sf_dir, "lineitem").select(F.expr(key).alias("key"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"))


def _npj(join: HashJoin, build="o_orderkey", probe="l_orderkey", copies=False):
    def run(spark, sf_dir):
        b = _orders(spark, sf_dir, build)
        if copies:
            b = b.union(b.filter("key % 10 = 0"))
        return join.probe_sum(b, _lines(spark, sf_dir, probe))

    return run


def _radix(bits: tuple[int, ...], scheme: HashingScheme, copies=False, placement="hash"):
    def run(spark, sf_dir):
        b = _orders(spark, sf_dir)
        if copies:
            b = b.union(b.filter("key % 10 = 0"))
        return radix_join_sum(b, _lines(spark, sf_dir), RadixBits(bits), scheme, placement)

    return run


def two_probes(spark, sf_dir):
    """One build side, probed by the lines with an even and by those with an odd number."""
    held = HashJoin(_LP).table(_orders(spark, sf_dir))
    sides = [_lines(spark, sf_dir, f"CASE WHEN l_linenumber % 2 = {k} THEN l_orderkey END") for k in (0, 1)]
    return held.probe_sum(sides[0]).union(held.copy(scheme=_PERFECT).probe_sum(sides[1]))


def table_lengths(spark, sf_dir):
    """Slots that tables over the orders would have, by scheme."""
    rows = _orders(spark, sf_dir).count()
    return spark.createDataFrame([(s.value, HashJoin(s).table_length(rows)) for s in (_PERFECT, _LP)], "scheme string, slots long")


_GAPS = "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END"
_HOLES = "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_orderkey END"


def _sql(build="o_orderkey", probe="l_orderkey", copies=False):
    rows = f"SELECT {build} AS key FROM orders"
    if copies:
        rows += f" UNION ALL SELECT {build} FROM orders WHERE o_orderkey % 10 = 0"
    return f"""
        SELECT CAST(coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)), 0) AS BIGINT) AS probe_sum
        FROM ({rows}) b JOIN lineitem ON b.key = {probe}"""


QUERIES = {
    "npj_linear_probing": _npj(HashJoin(_LP)),
    "npj_perfect": _npj(HashJoin(_PERFECT)),
    "npj_perfect_selective": _npj(HashJoin(_PERFECT, selective=True), build=_GAPS),
    "npj_duplicate_build_keys": _npj(HashJoin(_LP), copies=True),
    "npj_null_probe_keys": _npj(HashJoin(_LP), probe=_HOLES),
    "npj_out_of_range_probe": _npj(HashJoin(_PERFECT), probe="l_orderkey + 100"),
    "npj_int32_keys": _npj(HashJoin(_LP), build="CAST(o_orderkey AS INT)", probe="CAST(l_orderkey AS INT)"),
    "npj_broadcast": _npj(HashJoin(_LP, strategy=Strategy.BROADCAST)),
    "npj_shuffle_hash": _npj(HashJoin(_LP, strategy=Strategy.SHUFFLE_HASH)),
    "npj_sort_merge": _npj(HashJoin(_LP, strategy=Strategy.SORT_MERGE)),
    "radix_join_perfect": _radix((4,), _PERFECT),
    "radix_join_chaining": _radix((4,), _CHAIN, copies=True),
    "radix_join_two_pass": _radix((3, 3), _PERFECT),
    "radix_join_three_pass": _radix((2, 2, 2), _CHAIN),
    "radix_join_hash_exchange": _radix((3, 3), _PERFECT),
    "radix_join_by_id": _radix((3, 3), _PERFECT, placement="by_id"),
    "npj_table_of_two_probes": two_probes,
    "hash_table_lengths": table_lengths,
} | {f"join_method_{name}": _npj(HashJoin(_LP, strategy=s)) for name, s in EXECUTION_METHODS.items()} | {f"join_method_{name}": _radix((3, 3), _CHAIN, placement=p) for name, p in RADIX_METHODS.items()}

_PLAIN, _TWICE = _sql(), _sql(copies=True)
ORACLES = dict.fromkeys(QUERIES, _PLAIN) | {
    "npj_perfect_selective": _sql(build=_GAPS),
    "npj_duplicate_build_keys": _TWICE,
    "npj_null_probe_keys": _sql(probe=_HOLES),
    "npj_out_of_range_probe": _sql(probe="l_orderkey + 100"),
    "radix_join_chaining": _TWICE,
    "npj_table_of_two_probes": " UNION ALL ".join(_sql(probe=f"CASE WHEN l_linenumber % 2 = {k} THEN l_orderkey END") for k in (0, 1)),
    "hash_table_lengths": "SELECT 'perfect' AS scheme, count(*) AS slots FROM orders UNION ALL SELECT 'linear_probing', CAST(2 * pow(2, ceil(log2(count(*)))) AS BIGINT) FROM orders",
}
