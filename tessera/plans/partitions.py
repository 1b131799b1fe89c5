"""Radix partitioning, offsets, prefix sums and scalar functions as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import radix as R
from tessera.operators import partition as P
from tessera.operators.fold import dot_product, fold, fold_with_state
from tessera.operators.scan import exclusive_scan
from tessera.plans.harness import POINT
from tessera.session import scratch_folder, table
from tessera.sources import generators as G
from tessera.sources import relations as S

BITS, CHUNKS, PAD = R.RadixBits((4,)), 4, 8
TWO = R.RadixBits((3, 2))


def _orders(spark, sf_dir):
    """orders as a relation: o_orderkey is dense, so it is the place too."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") * 7 + F.col("o_orderkey")).alias("key"), cents.alias("value"))


def _chunked(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return P.with_partition(P.with_chunks(rows, rows.count(), CHUNKS), BITS)


def _counts(spark, sf_dir):
    return P.full_histogram(_chunked(spark, sf_dir), 16, CHUNKS)


def _chunk_rows(spark, sf_dir):
    return P.chunk_length(_orders(spark, sf_dir).count(), CHUNKS, 8)


def radix_histogram(spark, sf_dir):
    return P.histogram(P.with_partition(_orders(spark, sf_dir), BITS), "partition_id")


def chunked_histogram(spark, sf_dir):
    return _counts(spark, sf_dir)


def chunked_offsets_padded(spark, sf_dir):
    return P.chunked_offsets(_counts(spark, sf_dir), _chunk_rows(spark, sf_dir), 16, PAD)


def contiguous_offsets_padded(spark, sf_dir):
    return P.contiguous_offsets(_counts(spark, sf_dir), PAD)


def chunk_local_offsets(spark, sf_dir):
    return P.local_offsets(_counts(spark, sf_dir))


def partition_len_max(spark, sf_dir):
    return P.partition_lengths(_counts(spark, sf_dir)).agg(F.max("len").alias("max_len"), F.sum("len").alias("rows"))


def scatter_slots(spark, sf_dir):
    return P.scatter_slots(_chunked(spark, sf_dir), P.contiguous_offsets(_counts(spark, sf_dir), PAD)).select("pos", "slot")


def prefix_scan_exclusive(spark, sf_dir):
    return exclusive_scan(_orders(spark, sf_dir).select("pos", "value"), "pos", "value", block=4096)


def one_pass(spark, sf_dir):
    return P.partition(_orders(spark, sf_dir), BITS).select("pos", "key", "value", "pid")


def two_pass(spark, sf_dir):
    return P.partition(_orders(spark, sf_dir), TWO).select("pos", "key", "value", "p1", "p2", "pid")


def partition_slice(spark, sf_dir):
    return P.partition_slice(_chunked(spark, sf_dir), 3, 1).select("pos", "key", "value")


def copy_with_payload(spark, sf_dir):
    return P.copy_with_payload(_orders(spark, sf_dir), BITS)[0]


def copy_with_payload_counts(spark, sf_dir):
    return P.copy_with_payload(_orders(spark, sf_dir), BITS)[1]


def partition_capacity(spark, sf_dir):
    return P.partition_capacity(_counts(spark, sf_dir), PAD, 16)


def transform_partition(spark, sf_dir):
    return P.transform_partition(_chunked(spark, sf_dir), 5)


def task_assignment(spark, sf_dir):
    return P.assign_tasks(P.histogram(P.with_partition(_orders(spark, sf_dir), BITS), "partition_id"), 3)


def radix_partition_id(spark, sf_dir):
    return _orders(spark, sf_dir).select("pos", R.partition_id(F.col("key") - 5000, 5, 2).alias("pid"))


def mult_shift_hash32(spark, sf_dir):
    return _orders(spark, sf_dir).select("pos", R.multiply_shift_32(F.col("key"), 12).alias("h"))


def mult_shift_hash64(spark, sf_dir):
    return _orders(spark, sf_dir).select("pos", R.multiply_shift_64(F.col("key"), 12).alias("h"))


def mult_shift_hash64_full(spark, sf_dir):
    key = F.col("key") - 5000
    return _orders(spark, sf_dir).select("pos", R.multiply_shift_64_full(key, 12).alias("h"))


def murmur3_finalizer(spark, sf_dir):
    return _orders(spark, sf_dir).select("pos", R.murmur3_finalizer_32(F.col("key")).alias("h32"), R.murmur3_finalizer_64(F.col("key")).alias("h64"))


def log2_pow2(spark, sf_dir):
    x = F.col("key") + 1
    return _orders(spark, sf_dir).select("pos", R.log2_floor(x).cast("int").alias("low"), R.log2_ceil(x).cast("int").alias("high"))


def null_sentinel(spark, sf_dir):
    key = F.when(F.col("key") % 5 == 0, R.NULL_KEY).otherwise(F.col("key"))
    return _orders(spark, sf_dir).select("pos", R.from_sentinel(key).alias("key"), R.to_sentinel(R.from_sentinel(key)).alias("marked"))


def narrow_keys(spark, sf_dir):
    return _orders(spark, sf_dir).select("pos", R.narrow_key(F.col("key") * 100_000, "int", strict=False).alias("narrow"))


def day_numbers(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(R.day_number(F.col("l_shipdate").cast("date")).alias("day")).agg(F.count("*").alias("n"))


def dot(spark, sf_dir):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return dot_product(table(spark, sf_dir, "lineitem"), F.col("l_linenumber").cast("long"), cents)


def stateful_fold_sum(spark, sf_dir):
    import pandas as pd

    parts = fold_with_state(_orders(spark, sf_dir).select("value"), lambda: 0, lambda s, f: s + int(f["value"].sum()), lambda s: pd.DataFrame({"part": [s]}), "part long")
    return parts.agg(F.sum("part").alias("total"))


def fold_morsels(spark, sf_dir):
    """A stateless fold over morsels of 1000 rows at most."""
    doubled = fold(_orders(spark, sf_dir).select("value"), lambda f: f * 2, "value long", morsel_rows=1000)
    return doubled.agg(F.sum("value").alias("total"))


def fanouts(spark, sf_dir):
    return spark.range(1, 13).select(F.col("id").alias("bits"), R.fanout(F.col("id").cast("int")).alias("fanout"))


def radix_bits_parsed(spark, sf_dir):
    rows = [(text, k, b, bits.ignored(k), bits.fanout()) for text in ("8", "8,4", "2,3,4") for bits in [R.RadixBits.parse(text)] for k, b in enumerate(bits.passes, 1)]
    return spark.createDataFrame(rows, "text string, number long, bits long, ignored long, fanout long")


def relation_round_trip(spark, sf_dir):
    """Orders as a relation file, written with in-band nulls and read back."""
    path = scratch_folder(spark, "relation")
    rows = _orders(spark, sf_dir).select(F.when(F.col("key") % 5 != 0, F.col("key")).alias("key"), "value")
    S.write_relation(rows, path)
    back = S.read_relation(spark, path)
    return back.select(R.from_sentinel(F.col("key")).alias("key"), "value")


def relation_join(spark, sf_dir):
    """A join whose two sides are read from comma files."""
    paths = [scratch_folder(spark, side) for side in ("inner", "outer")]
    rows = _orders(spark, sf_dir)
    S.write_relation(rows.select(F.col("pos").alias("key"), "value"), paths[0], "csv", compress=False)
    S.write_relation(rows.select((F.col("pos") * 2).alias("key"), "value"), paths[1], "csv", compress=False)
    build, probe = S.read_join(spark, *paths, sep=",")
    return probe.join(build.select("key"), "key").agg(F.sum("value").alias("probe_sum"))


def measurement_csv(spark, sf_dir):
    """Two files of measurements with a list column, read back together."""
    paths = [scratch_folder(spark, "points") for _ in range(2)]
    for k, path in enumerate(paths):
        points = spark.createDataFrame([(f"q{k}", k == 0, k, 0.5 * k, 10, 20.0)], POINT)
        S.write_points(points.withColumn("threads", F.array(F.lit(1), F.lit(2 + k))), path)
    return S.read_points(spark, *paths, schema=f"{POINT}, threads string")


def gen_uniform(spark, sf_dir):
    """Draws from [5, 25): every value occurs, each near its share."""
    counts = G.uniform(spark, 20_000, 5, 25).groupBy("key").agg(F.count("*").alias("n"))
    return counts.select("key", F.col("n").between(800, 1200).alias("near"))


def gen_zipf(spark, sf_dir):
    """Draws over 40 million ranks: the first ranks have their shares of the harmonic sum, and no draw lies outside."""
    draws = G.zipf(spark, 50_000, 40_000_000, 1.0)
    # Harmonic number of 40 million: log(n) + 0.5772...
    share = F.lit(50_000 / 18.0817) / (F.col("key") + 1)
    heads = draws.filter("key < 4").groupBy("key").agg(F.count("*").alias("n"))
    bad = draws.filter("key < 0 OR key >= 40000000").count()
    return heads.select("key", (F.abs(F.col("n") - share) < 5 * F.sqrt(share)).alias("near"), F.lit(bad).alias("outside"))


def gen_lineitem(spark, sf_dir):
    rows = G.lineitem(spark, 0.001)
    inside = lambda c, low, high: ((F.min(c) >= low) & (F.max(c) <= high)).alias(c)
    return rows.agg(F.count("*").between(5990, 6010).alias("sized"), inside("shipdate", 0, 2555), inside("discount", 0, 10), inside("quantity", 1, 50), inside("extendedprice", 1, 2**31 - 2))


def gen_presets(spark, sf_dir):
    names = ["kim", "blanas", "blanas4mb", "test", "2gib_32gib", "32gib_32gib"]
    return spark.createDataFrame([(n, G.preset(n).inner, G.preset(n).outer) for n in names], "name string, build_rows long, probe_rows long")


def gen_scaled_presets(spark, sf_dir):
    """The kim and blanas inputs at a ten-thousandth: every probe key has its build key, so the sum is that of all probes."""
    sums = []
    for name in ("kim", "blanas"):
        build, probe = G.join_input(spark, G.preset(name), scale=1e-4)
        sums.append(probe.join(build.select("key"), "key").agg(F.lit(name).alias("name"), F.sum("value").alias("probe_sum")))
    return sums[0].union(sums[1])


def gen_payload(spark, sf_dir):
    """Payloads drawn from [0, 10000), by a caller's own generator."""
    own = lambda spark, rows: G.join_input(spark, G.DataSet(rows, 3 * rows, 0.5, payload=(0, 10_000)))
    build, probe = G.generated(spark, own, rows=2000)
    value = build.union(probe).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return value.select("n", ((F.col("low") >= 0) & (F.col("low") < 50)).alias("low"), F.col("high").between(9950, 9999).alias("high"))


def gen_selectivity(spark, sf_dir):
    """Keys kept at 0, 30 and 100 percent."""
    kept = [G.primary_key(spark, 20_000, p).agg(F.lit(p).alias("percent"), F.abs(F.count("key") - 200 * p).alias("off")) for p in (0, 30, 100)]
    return kept[0].union(kept[1]).union(kept[2]).select("percent", (F.col("off") < 400).alias("near"))


def gen_primary_key(spark, sf_dir):
    return G.primary_key(spark, 5000, seed=11).agg(F.count("key").alias("n"), F.count_distinct("key").alias("distinct_keys"), F.min("key").alias("low"), F.max("key").alias("high"), F.sum("key").alias("total"))


def gen_foreign_key(spark, sf_dir):
    return G.foreign_key_from_primary(G.primary_key(spark, 500), 1750).groupBy("key").agg(F.count("*").alias("times"))


def gen_zipf_cdf(spark, sf_dir):
    return G.zipf_cdf(spark, 200, 1.0).select("rank", F.round("cdf", 9).alias("cdf"))


def gen_join_test_set(spark, sf_dir):
    build, probe = G.join_input(spark, G.preset("test"))
    return probe.join(build.select("key"), "key").agg(F.sum("value").alias("probe_sum"))


QUERIES = {
    f.__name__: f
    for f in (
        radix_histogram, chunked_histogram, chunked_offsets_padded, contiguous_offsets_padded, chunk_local_offsets, partition_len_max, scatter_slots, prefix_scan_exclusive,
        partition_slice, copy_with_payload, copy_with_payload_counts, partition_capacity, transform_partition, task_assignment, radix_partition_id, mult_shift_hash32, mult_shift_hash64, mult_shift_hash64_full, murmur3_finalizer, log2_pow2, null_sentinel,
        narrow_keys, day_numbers, stateful_fold_sum, gen_primary_key, gen_foreign_key, gen_zipf_cdf, gen_join_test_set,
        fold_morsels, fanouts, radix_bits_parsed, relation_round_trip, relation_join, measurement_csv, gen_uniform, gen_zipf, gen_lineitem, gen_presets, gen_scaled_presets, gen_payload, gen_selectivity,
    )
} | {"radix_partition_one_pass": one_pass, "radix_partition_two_pass": two_pass, "dot_product": dot}

_REL = "SELECT o_orderkey AS pos, o_custkey * 7 + o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders"
_SIZED = f"(CAST(ceil((SELECT count(*) FROM orders) / {CHUNKS}.0) AS BIGINT) // 16 * 16)"
_CH = f"rel AS ({_REL}), ch AS (SELECT *, CAST(least(pos // {_SIZED}, {CHUNKS - 1}) AS INTEGER) AS chunk_id, CAST(key & 15 AS INTEGER) AS partition_id FROM rel)"
_GRID = f"""{_CH}, h AS (
    SELECT CAST(c.range AS INTEGER) AS chunk_id, CAST(p.range AS INTEGER) AS partition_id, count(ch.pos) AS cnt
    FROM range({CHUNKS}) c CROSS JOIN range(16) p LEFT JOIN ch ON ch.chunk_id = c.range AND ch.partition_id = p.range GROUP BY 1, 2)"""
_BEFORE = "coalesce(sum(cnt) OVER (PARTITION BY chunk_id ORDER BY partition_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_CONT = f"SELECT *, CAST({PAD} * (partition_id + 1) + coalesce(sum(cnt) OVER (ORDER BY partition_id, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM h"
_WRAP64 = "CAST((CAST({k} AS HUGEINT) * 11400714819323198485) % 18446744073709551616 // 4503599627370496 AS BIGINT)"



def _avalanche(x: str, steps: tuple[int, ...], bits: int) -> str:
    """Murmur3's finalizer as SQL over unsigned integers."""
    a, f, b, g, c = steps
    wrap = lambda x, factor: f"({x} * CAST({factor} AS UHUGEINT) % CAST({2**bits} AS UHUGEINT))"
    fold_ = lambda x, shift: f"xor({x}, {x} >> {shift})"
    return fold_(wrap(fold_(wrap(fold_(x, a), f), b), g), c)


ORACLES = {
    "radix_histogram": f"SELECT CAST(key & 15 AS INTEGER) AS partition_id, count(*) AS cnt FROM ({_REL}) GROUP BY 1",
    "copy_with_payload": f"SELECT key, value, CAST(key & 15 AS INTEGER) AS partition_id FROM ({_REL})",
    "copy_with_payload_counts": f"SELECT CAST(key & 15 AS INTEGER) AS partition_id, count(*) AS cnt FROM ({_REL}) GROUP BY 1",
    "partition_capacity": f"SELECT CAST(key & 15 AS INTEGER) AS partition_id, count(*) AS len, count(*) + {PAD} AS padded_len, (count(*) + {PAD}) * 16 AS bytes FROM ({_REL}) GROUP BY 1",
    "murmur3_finalizer": f"""
        WITH k AS (SELECT pos, key FROM ({_REL})),
        a AS (SELECT pos, key, {_avalanche('CAST(key AS UHUGEINT)', R.MURMUR_32, 32)} AS x, {_avalanche('CAST(key AS UHUGEINT)', R.MURMUR_64, 64)} AS y FROM k)
        SELECT pos, CAST(CASE WHEN x >= 2147483648 THEN CAST(x AS HUGEINT) - 4294967296 ELSE CAST(x AS HUGEINT) END AS INTEGER) AS h32,
               CAST(CASE WHEN y >= 9223372036854775808 THEN CAST(y AS HUGEINT) - 18446744073709551616 ELSE CAST(y AS HUGEINT) END AS BIGINT) AS h64 FROM a""",
    "fold_morsels": f"SELECT CAST(2 * sum(value) AS BIGINT) AS total FROM ({_REL})",
    "fanouts": "SELECT range AS bits, 1::BIGINT << range AS fanout FROM range(1, 13)",
    "radix_bits_parsed": "SELECT * FROM (VALUES ('8', 1::BIGINT, 8::BIGINT, 0::BIGINT, 256::BIGINT), ('8,4', 1, 8, 0, 4096), ('8,4', 2, 4, 8, 4096), ('2,3,4', 1, 2, 0, 512), ('2,3,4', 2, 3, 2, 512), ('2,3,4', 3, 4, 5, 512)) v(text, number, bits, ignored, fanout)",
    "relation_round_trip": f"SELECT CASE WHEN key % 5 <> 0 THEN key END AS key, value FROM ({_REL})",
    "relation_join": f"SELECT CAST(sum(o.value) AS BIGINT) AS probe_sum FROM ({_REL}) i JOIN ({_REL}) o ON i.pos = 2 * o.pos",
    "measurement_csv": "SELECT 'q' || range AS query, range = 0 AS warm_up, CAST(range AS INTEGER) AS run, 0.5::DOUBLE * range AS seconds, 10::BIGINT AS tuples, 20.0::DOUBLE AS tuples_per_second, '1,' || (2 + range) AS threads FROM range(2)",
    "gen_uniform": "SELECT range AS key, true AS near FROM range(5, 25)",
    "gen_zipf": "SELECT range AS key, true AS near, CAST(0 AS INTEGER) AS outside FROM range(4)",
    "gen_lineitem": "SELECT true AS sized, true AS shipdate, true AS discount, true AS quantity, true AS extendedprice",
    "gen_presets": "SELECT * FROM (VALUES ('kim', 128000000::BIGINT, 128000000::BIGINT), ('blanas', 16777216, 268435456), ('blanas4mb', 524288, 268435456), ('test', 1000, 1000), ('2gib_32gib', 134217728, 2147483648), ('32gib_32gib', 2147483648, 2147483648)) v(name, build_rows, probe_rows)",
    "gen_scaled_presets": "SELECT 'kim' AS name, CAST(12800::BIGINT * 12801 / 2 AS BIGINT) AS probe_sum UNION ALL SELECT 'blanas', CAST(26843::BIGINT * 26844 / 2 AS BIGINT)",
    "gen_payload": "SELECT 8000::BIGINT AS n, true AS low, true AS high",
    "gen_selectivity": "SELECT CAST(p AS INTEGER) AS percent, true AS near FROM (VALUES (0), (30), (100)) v(p)",
    "chunked_histogram": f"WITH {_GRID} SELECT * FROM h",
    "chunked_offsets_padded": f"WITH {_GRID} SELECT *, CAST(chunk_id * ({_SIZED} + {PAD * 16}) + {PAD} * (partition_id + 1) + {_BEFORE} AS BIGINT) AS \"offset\" FROM h",
    "contiguous_offsets_padded": f"WITH {_GRID} {_CONT}",
    "chunk_local_offsets": f"WITH {_GRID} SELECT *, CAST({_BEFORE} AS BIGINT) AS local_offset FROM h",
    "partition_len_max": f"SELECT max(n) AS max_len, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM ({_REL}) GROUP BY key & 15)",
    "scatter_slots": f"WITH {_GRID}, o AS ({_CONT}) SELECT pos, CAST(\"offset\" + row_number() OVER (PARTITION BY chunk_id, partition_id ORDER BY pos) - 1 AS BIGINT) AS slot FROM ch JOIN o USING (chunk_id, partition_id)",
    "prefix_scan_exclusive": f"SELECT pos, value, CAST(coalesce(sum(value) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM ({_REL})",
    "radix_partition_one_pass": f"SELECT pos, key, value, CAST(key & 15 AS INTEGER) AS pid FROM ({_REL})",
    "radix_partition_two_pass": f"SELECT pos, key, value, CAST(key & 7 AS INTEGER) AS p1, CAST((key >> 3) & 3 AS INTEGER) AS p2, CAST((key & 7) * 4 + ((key >> 3) & 3) AS INTEGER) AS pid FROM ({_REL})",
    "partition_slice": f"WITH {_CH} SELECT pos, key, value FROM ch WHERE chunk_id = 1 AND partition_id = 3",
    "transform_partition": f"WITH {_CH} SELECT chunk_id, pos, key, value FROM ch WHERE partition_id = 5",
    "task_assignment": f"""
        WITH RECURSIVE h AS (SELECT key & 15 AS p, count(*) AS cnt FROM ({_REL}) GROUP BY 1), m AS (SELECT CAST(ceil(sum(cnt) / 3.0) AS BIGINT) AS mean FROM h),
        t(p, worker, load, of) AS (
            SELECT CAST(-1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
            UNION ALL SELECT CAST(h.p AS BIGINT), CASE WHEN load + cnt >= mean AND worker < 3 THEN worker + 1 ELSE worker END,
                   CASE WHEN load + cnt >= mean AND worker < 3 THEN 0 ELSE load + cnt END, worker FROM t JOIN h ON h.p = t.p + 1, m)
        SELECT CAST(t.p AS INTEGER) AS partition_id, h.cnt, t.of AS worker FROM t JOIN h ON h.p = t.p""",
    "radix_partition_id": f"SELECT pos, ((key - 5000) & 124) >> 2 AS pid FROM ({_REL})",
    "mult_shift_hash32": f"SELECT pos, CAST((key * 2654435769) % 4294967296 // 1048576 AS BIGINT) AS h FROM ({_REL})",
    "mult_shift_hash64": f"SELECT pos, {_WRAP64.format(k='key')} AS h FROM ({_REL})",
    "mult_shift_hash64_full": f"SELECT pos, {_WRAP64.format(k='(key - 5000 + CASE WHEN key < 5000 THEN 18446744073709551616 ELSE 0 END) % 4294967296')} AS h FROM ({_REL}) WHERE key >= 5000 UNION ALL SELECT pos, CAST((18446744073709551616 - (CAST(5000 - key AS HUGEINT) * 11400714819323198485) % 18446744073709551616) % 18446744073709551616 // 4503599627370496 AS BIGINT) AS h FROM ({_REL}) WHERE key < 5000",
    "log2_pow2": f"SELECT pos, CAST(length(bin(key + 1)) - 1 AS INTEGER) AS low, CAST(CASE WHEN key > 0 THEN length(bin(key)) ELSE 0 END AS INTEGER) AS high FROM ({_REL})",
    "null_sentinel": f"SELECT pos, CASE WHEN key % 5 = 0 THEN NULL ELSE key END AS key, CASE WHEN key % 5 = 0 THEN -1 ELSE key END AS marked FROM ({_REL})",
    "narrow_keys": f"SELECT pos, TRY_CAST(key * 100000 AS INTEGER) AS narrow FROM ({_REL})",
    "day_numbers": "SELECT CAST(CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS INTEGER) AS day, count(*) AS n FROM lineitem GROUP BY 1",
    "dot_product": "SELECT CAST(sum(CAST(l_linenumber AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS dot FROM lineitem",
    "stateful_fold_sum": f"SELECT CAST(sum(value) AS BIGINT) AS total FROM ({_REL})",
    "gen_primary_key": "SELECT count(*) AS n, count(DISTINCT range) AS distinct_keys, min(range) AS low, max(range) AS high, CAST(sum(range) AS BIGINT) AS total FROM range(5000)",
    "gen_foreign_key": "SELECT range % 500 AS key, count(*) AS times FROM (SELECT (range * 309 + 1) % 500 AS range FROM range(1750)) GROUP BY 1",
    "gen_zipf_cdf": "SELECT range AS rank, round(sum(1.0::DOUBLE / range) OVER (ORDER BY range) / sum(1.0::DOUBLE / range) OVER (), 9) AS cdf FROM range(1, 201)",
    "gen_join_test_set": "SELECT CAST(1000 * 1001 / 2 AS BIGINT) AS probe_sum",
}
