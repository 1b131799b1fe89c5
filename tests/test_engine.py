"""Invariants of joins, partitioning, scans and generators on seeded inputs, and the SQL counterparts on small tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import radix as R
from tessera.operators import partition as P
from tessera.operators.fold import dot_product, fold, fold_with_state
from tessera.operators.hash_join import HashingScheme, HashJoin, Strategy, radix_join_sum
from tessera.operators.scan import exclusive_scan
from tessera.plans import registry
from tessera.plans.harness import measure
from tessera.sources import generators as G
from tessera.sources import relations as S

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def pk_fk(spark, n, percent=100):
    build = G.primary_key(spark, n, percent, seed=3).select("key", (F.col("pos") + 1).alias("value"))
    probe = G.primary_key(spark, n, seed=9).select("key", (F.col("pos") + 1).alias("value"))
    return build, probe


@pytest.mark.parametrize("scheme", [HashingScheme.PERFECT, HashingScheme.LINEAR_PROBING])
@pytest.mark.parametrize("strategy", list(Strategy))
def test_join_sum_is_closed_form(spark, scheme, strategy):
    build, probe = pk_fk(spark, 1000)
    assert HashJoin(scheme, strategy=strategy).probe_sum(build, probe).first()[0] == 1000 * 1001 // 2


def test_join_null_duplicate_and_empty(spark):
    build = spark.createDataFrame([(1, 0), (1, 0), (None, 0), (2, 0)], "key long, value long")
    probe = spark.createDataFrame([(1, 10), (2, 5), (None, 100), (7, 1000)], "key long, value long")
    assert HashJoin(HashingScheme.LINEAR_PROBING).probe_sum(build, probe).first()[0] == 25
    assert HashJoin(HashingScheme.PERFECT).probe_sum(build, probe).first()[0] == 15
    assert HashJoin().probe_sum(build.limit(0), probe).first()[0] == 0
    with pytest.raises(ValueError):
        HashJoin(HashingScheme.PERFECT, validate=True).probe_sum(build, probe)


def test_oversized_broadcast_falls_back(spark):
    build, probe = pk_fk(spark, 200)
    plan = HashJoin(strategy=Strategy.BROADCAST, broadcast_rows=10).probe_sum(build, probe)
    assert plan.first()[0] == 200 * 201 // 2
    assert "ShuffledHashJoin" in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("bits", [(0,), (3,), (3, 3), (2, 2, 2)])
@pytest.mark.parametrize("scheme", [HashingScheme.PERFECT, HashingScheme.BUCKET_CHAINING])
def test_radix_join(spark, bits, scheme):
    build, probe = pk_fk(spark, 600)
    for placement in ("hash", "by_id", "first_pass", "first_pass_sorted"):
        assert radix_join_sum(build, probe, R.RadixBits(bits), scheme, placement).first()[0] == 600 * 601 // 2


def test_radix_placements_make_one_exchange_a_side(spark):
    build, probe = pk_fk(spark, 600)
    for placement, join in (("first_pass", "ShuffledHashJoin"), ("first_pass_sorted", "SortMergeJoin"), ("by_id", "ShuffledHashJoin")):
        plan = radix_join_sum(build, probe, R.RadixBits((3, 3)), HashingScheme.BUCKET_CHAINING, placement)._jdf.queryExecution().executedPlan().toString()
        assert join in plan and plan.count("Exchange") == 3  # two sides and the final sum
    with pytest.raises(ValueError):
        radix_join_sum(build, probe, R.RadixBits((3,)), placement="elsewhere")


def test_build_side_for_several_probes(spark):
    build, probe = pk_fk(spark, 300)
    held = HashJoin().table(build)
    assert held.probe_sum(probe).first()[0] == held.copy(scheme=HashingScheme.PERFECT).probe_sum(probe).first()[0] == 300 * 301 // 2
    held.free()
    holes = build.withColumn("key", F.when(F.col("key") > 9, F.col("key")))
    with pytest.raises(ValueError):
        HashJoin(validate=True).probe_sum(holes, probe)
    assert HashJoin(validate=True, selective=True).probe_sum(holes, probe).first()[0] < 300 * 301 // 2


@pytest.mark.parametrize("rows,bits", [(15, (4,)), (1000, (0,)), (1001, (5,)), (700, (2, 3))])
def test_partition_loses_nothing_and_places_rightly(spark, rows, bits):
    bits = R.RadixBits(bits)
    data = G.uniform(spark, rows, -5000, 5000, seed=1).withColumn("value", F.col("pos"))
    out = P.partition(data, bits).withColumn("task", F.spark_partition_id())
    assert out.filter("task != pid").isEmpty()
    back = out.select(data.columns)
    assert back.exceptAll(data).isEmpty() and data.exceptAll(back).isEmpty()


def test_offsets_and_slots_are_disjoint(spark):
    data = G.uniform(spark, 1003, 0, 10**6, seed=2).withColumn("value", F.col("pos"))
    rows = P.with_partition(P.with_chunks(data, 1003, 4), R.RadixBits((3,)))
    counts = P.full_histogram(rows, 8, 4)
    chunk = P.chunk_length(1003, 4, 8)
    last = 1003 - 3 * chunk
    for offsets in (P.chunked_offsets(counts, chunk, 8, 8), P.contiguous_offsets(counts, 8)):
        slots = P.scatter_slots(rows, offsets, block=100)
        assert slots.select("slot").distinct().count() == 1003
        assert slots.exceptAll(P.scatter_slots(rows, offsets)).isEmpty()
    assert last > 0
    assert P.with_chunks(data, 3, 8).agg(F.max("chunk_id")).first()[0] == 7


def test_scan_equals_numpy(spark):
    values = np.random.default_rng(5).integers(0, 10**6, 3000)
    rows = spark.createDataFrame(pd.DataFrame({"i": np.arange(3000), "v": values}))
    got = exclusive_scan(rows, "i", "v", block=128).orderBy("i").toPandas()["prefix"].to_numpy()
    assert (got == np.append(0, np.cumsum(values)[:-1])).all()


def test_task_assignment_small(spark):
    counts = spark.createDataFrame([(0, 5), (1, 5), (2, 0), (3, 9), (4, 1)], "partition_id int, cnt long")
    got = [r.worker for r in P.assign_tasks(counts, 3).orderBy("partition_id").collect()]
    assert got == [1, 1, 2, 2, 3]
    assert {r.worker for r in P.assign_tasks(counts, 1).collect()} == {1}


def test_hashes_equal_plain_integers(spark):
    keys = [0, 1, 77, 2**31 - 1]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    got = rows.select(R.multiply_shift_32(F.col("k"), 10), R.multiply_shift_64(F.col("k"), 10), R.multiply_shift_64_full(F.col("k"), 10), R.murmur3_finalizer_64(F.col("k"))).collect()
    for k, r in zip(keys, got):
        assert r[0] == (k * R.FACTOR_32 % 2**32) >> 22
        assert r[1] == r[2] == (k * R.FACTOR_64 % 2**64) >> 54
        x = k
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x ^ (x >> shift)) * factor % 2**64
        x ^= x >> 33
        assert r[3] % 2**64 == x
    for k, r in zip([*keys, -5, 2**63 - 1], spark.createDataFrame([(k,) for k in [*keys, -5, 2**63 - 1]], "k long").select(R.murmur3_finalizer_32(F.col("k"))).collect()):
        x = k % 2**32
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            x = (x ^ (x >> shift)) * factor % 2**32
        assert r[0] % 2**32 == x ^ (x >> 16)
    for factor in (R.FACTOR_64, 2**64 - 1, 3):
        odd = [-1, -(2**63), 2**63 - 1, 2**32, 2**32 - 1, -(2**33) + 7]
        got = spark.createDataFrame([(k,) for k in odd], "k long").select(R.wrapped_product(F.col("k"), factor)).collect()
        assert [r[0] % 2**64 for r in got] == [k * factor % 2**64 for k in odd]
    wide = spark.createDataFrame([(-1,), (-(2**63),), (None,)], "k long").select(R.multiply_shift_64_full(F.col("k"), 8)).collect()
    assert [r[0] for r in wide] == [(-1 % 2**64 * R.FACTOR_64 % 2**64) >> 56, (2**63 * R.FACTOR_64 % 2**64) >> 56, None]


def test_radix_bits():
    bits = R.RadixBits.parse("8,4")
    assert bits.fanout() == 4096 and bits.ignored(2) == 8
    for wrong in ("", "1,2,3,4", "a", "-1"):
        with pytest.raises(ValueError):
            R.RadixBits.parse(wrong)


def test_generators(spark):
    keys = [r.key for r in G.primary_key(spark, 997).collect()]
    assert sorted(keys) == list(range(997)) and keys != sorted(keys)
    kept = G.primary_key(spark, 20_000, 30).filter("key IS NOT NULL").count()
    assert 5400 < kept < 6600
    z = G.zipf(spark, 5000, 50, 1.2).groupBy("key").count().toPandas().set_index("key")["count"]
    assert z.index.min() == 0 and z.index.max() < 50 and z[0] > 3 * z.get(5, 0)
    u = G.uniform(spark, 2000, 5, 9).agg(F.min("key"), F.max("key")).first()
    assert tuple(u) == (5, 8)
    assert G.lineitem(spark, 0.0001).count() > 500
    with pytest.raises(ValueError):
        G.primary_key(spark, 10, 101)


@pytest.mark.parametrize("kind,compress", [("tsv", True), ("csv", False)])
def test_relation_files_round_trip(spark, tmp_path, kind, compress):
    rows = S.numbered(G.primary_key(spark, 300))
    S.write_relation(rows, str(tmp_path / "r"), kind, compress)
    back = S.read_relation(spark, str(tmp_path / "r"), sep=S.SEPARATORS[kind])
    assert back.exceptAll(rows).isEmpty() and back.count() == 300


def test_command_writes_both_relations(spark, tmp_path):
    from tessera.sources import cli

    cli.main([str(tmp_path), "--inner", "100", "--outer", "500", "--kind", "csv", "--no-compress", "--payload-below", "50"])
    inner, outer = S.read_join(spark, str(tmp_path / "inner"), str(tmp_path / "outer"), sep=",")
    assert inner.count() == 100 and outer.count() == 500 and outer.agg(F.max("value")).first()[0] < 50
    assert outer.join(inner.select("key"), "key").count() == 500


def test_points_and_harness(spark, tmp_path):
    points = measure(spark, "q", lambda: spark.range(10), repeat=2, tuples=10)
    assert [r.warm_up for r in points.orderBy("run").collect()] == [True, False, False]
    S.write_points(points.withColumn("list", F.array(F.lit(1), F.lit(2))), str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).first()["list"] == "1,2"


def test_folds(spark):
    rows = spark.range(1000).select(F.col("id").alias("x"), F.lit(1).alias("y"))
    assert fold(rows, lambda f: f[["x"]] * 2, "x long").agg(F.sum("x")).first()[0] == 999_000
    parts = fold_with_state(rows, lambda: 0, lambda s, f: s + int(f["x"].sum()), lambda s: pd.DataFrame({"s": [s]}), "s long")
    assert parts.agg(F.sum("s")).first()[0] == 499_500
    assert dot_product(rows, F.col("x"), F.col("y")).first()[0] == 499_500




@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, DATA)
    order = [got.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[k] for k in order)) for r in got.collect()) == sorted(map(repr, want.fetchall()))
