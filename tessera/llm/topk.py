"""Exact top-k inner products over vectors sorted by length, with rotated partial sums and Cauchy-Schwarz bounds.

Vectors are rotated by the right singular vectors of the whole table, so leading coordinates carry most of each
product. Candidates lie in blocks by descending length; a block pair is worked through in steps of leading
coordinates, and a candidate drops out as soon as its partial sum plus the product of both residual lengths stays below
the query's threshold. The first block's k-th score is every later block's starting threshold. What survives is scored
exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import arrow_limits, written

#: Vectors in a block of candidates and in a block of queries.
CANDIDATES, QUERIES = 4096, 1024
#: Coordinates after which bounds are tested; the last test is followed by the exact product.
STEPS = (8, 16, 32)
#: Relative slack of the floating-point bounds.
SLACK = 1e-6
#: Below every score; its negation is an integer of 64 bits too.
NO_SCORE = -(2**62)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long integer lists as a matrix."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(rows, -1) if rows and len(flat) else np.zeros((rows, 0), np.int64)


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and x = floor(scale * component) of every vector that is not null and holds no null or non-finite part.

    Components so large that a product sum might leave 64 bits raise an error: no score is wrong silently.
    """
    parts = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & parts.isNotNull() & ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    most = F.sqrt(F.lit(2.0**62) / F.greatest(F.size(parts), F.lit(1)))
    wide = F.raise_error(F.lit("a component is too large for exact scores of 64 bits")).cast("array<bigint>")
    whole = F.transform(parts, lambda x: F.floor(x * scale).cast("long"))
    # A generator stands between the steps, so that the integers are made once.
    rows = vectors.filter(good).select("vec_id", F.explode(F.array(whole)).alias("x"), most.alias("most"))
    return rows.select("vec_id", F.when(F.greatest(F.array_max("x"), -F.array_min("x")) >= F.col("most") - 1, wide).otherwise(F.col("x")).alias("x"))


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's sum of outer products by dimension: d * d numbers, whatever the rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        size = batch.column("d").to_numpy()
        for d in np.unique(size):
            x = _matrix(batch.column("x").filter(pa.array(size == d))).astype(np.float64)
            sums[int(d)] = sums.get(int(d), 0) + x.T @ x
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], ["d", "gram"])


def _rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the right singular vectors of its vectors: a d x d matrix, from sums made in the tasks."""
    parts = rows.select("x", F.size("x").cast("long").alias("d")).mapInArrow(_gram, "d long, gram array<double>")
    flat = parts.select("d", F.posexplode("gram").alias("k", "g")).groupBy("d", "k").agg(F.sum("g").alias("g"))
    found: dict[int, np.ndarray] = {}
    for row in flat.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("k", "g"))).alias("m")).collect():
        m = np.array([x["g"] for x in row["m"]]).reshape(row["d"], row["d"])
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        found[row["d"]] = np.ascontiguousarray(vectors[:, np.argsort(-values)])
    return found


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of a task's vectors: ids and components as bytes. Blocks arrive together and sorted."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        x = _matrix(t["x"].chunk(0) if t.num_rows else pa.array([], pa.list_(pa.int64())))
        cut = lambda v, kind: pa.array([v], kind)
        return pa.RecordBatch.from_arrays([cut(t["d"][0].as_py(), pa.int64()), cut(t["block"][0].as_py(), pa.int64()), cut(t["vec_id"].to_numpy().astype("<i8").tobytes(), pa.binary()), cut(x.astype("<i8").tobytes(), pa.binary()), cut(float(np.sqrt((x.astype(np.float64) ** 2).sum(1)).max(initial=0)), pa.float64())], ["d", "block", "ids", "x", "longest"])

    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        d, block = batch.column("d").to_numpy(), batch.column("block").to_numpy()
        edges = np.flatnonzero((d[1:] != d[:-1]) | (block[1:] != block[:-1])) + 1
        for s, e in zip(np.append(0, edges), np.append(edges, len(d))):
            if s == e:
                continue
            now = (int(d[s]), int(block[s]))
            if key is not None and now != key:
                yield flush(held)
                held = []
            key = now
            held.append(batch.slice(s, e - s))
    if held:
        yield flush(held)


def _blocks(rows: DataFrame, size: int, salted: bool) -> DataFrame:
    """Vectors in blocks of about `size` rows: (d, block, ids, x). Candidates by descending length, queries by hash.

    Block numbers of candidates come from two-level counting: a histogram of squared lengths gives each length its
    place, and rows of one length are dealt over as many blocks as they fill, so ties of any number are split.
    """
    rows = rows.withColumn("d", F.size("x").cast("long"))
    if salted:
        count = max(1, -(-rows.count() // size))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count)))
    else:
        # Squared lengths fall into classes of at most one part in 64; classes are few, however many the rows.
        norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
        rows = rows.withColumn("class", F.floor(F.log2(norm + 1) * 44).cast("long"))
        sizes = rows.groupBy("d", "class").agg(F.count("*").alias("n"))
        above = Window.partitionBy("d").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0)))
        first = F.floor(F.col("before") / size).cast("long")
        spread = F.greatest(F.lit(1), F.ceil((F.col("before") % size + F.col("n")) / size)).cast("long")
        rows = rows.join(F.broadcast(sizes.select("d", "class", first.alias("first"), spread.alias("spread"))), ["d", "class"])
        rows = rows.withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("spread")))
    rows = rows.select("vec_id", "x", "d", "block")
    return rows.repartition("d", "block").sortWithinPartitions("d", "block").mapInArrow(_packed, "d long, block long, ids binary, x binary, longest double")


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vec_id, score) of each query's best k within the block, scores under `floor` left out.

    The candidates are worked off by descending length in slices, so thresholds rise early; within a slice the bounds
    after each step of rotated coordinates decide which pairs are still open.
    """
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    x, x_ids, lengths = x[order], x_ids[order], lengths[order]
    qr, xr = q.astype(np.float64) @ rotation, x.astype(np.float64) @ rotation
    q_len = np.sqrt((qr**2).sum(1))
    rest = lambda m, s: np.sqrt((m[:, s:] ** 2).sum(1))
    steps = [s for s in STEPS if s < q.shape[1]]
    rests = [(rest(qr, s), rest(xr, s)) for s in steps]
    limit = floor.astype(np.float64).copy()
    best_score = np.full((len(q), k), NO_SCORE, np.int64)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    for first in range(0, len(x), 512):
        part = slice(first, min(first + 512, len(x)))
        slack = SLACK * (1 + q_len * lengths[first])
        # Lengths descend: once the longest candidate left cannot reach a query's threshold, that query is done.
        alive = np.flatnonzero(q_len * lengths[first] + slack >= limit)
        if not len(alive):
            break
        at, sums = 0, np.zeros((len(alive), part.stop - part.start))
        for s, (qs, xs) in zip(steps, rests):
            sums += qr[alive, at:s] @ xr[part, at:s].T
            at = s
            possible = sums + np.outer(qs[alive], xs[part]) + slack[alive][:, None] >= limit[alive][:, None]
            keep = possible.any(1)
            alive, sums, possible = alive[keep], sums[keep], possible[keep]
            if not len(alive):
                break
        if not len(alive):
            continue
        i, j = np.nonzero(possible) if steps else (np.repeat(np.arange(len(alive)), part.stop - part.start), np.tile(np.arange(part.stop - part.start), len(alive)))
        row, col = alive[i], first + j
        score = np.einsum("ij,ij->i", q[row], x[col])
        other = x_ids[col] != q_ids[row]
        row, col, score = row[other], col[other], score[other]
        # Merge with what each query holds: rank by score, then by smaller id.
        rows = np.concatenate([np.repeat(alive, k), row])
        scores = np.concatenate([best_score[alive].ravel(), score])
        ids = np.concatenate([best_id[alive].ravel(), x_ids[col]])
        o = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[o], scores[o], ids[o]
        begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        top = begin[:, None] + np.arange(k)
        best_score[rows[begin]], best_id[rows[begin]] = scores[top], ids[top]
        limit[rows[begin]] = np.maximum(limit[rows[begin]], best_score[rows[begin], -1])
    place, rank = np.nonzero((best_id != np.iinfo(np.int64).max) & (best_score >= floor[:, None]))
    return place, best_id[place, rank], best_score[place, rank]


_FOUND = "d long, query_id long, vec_id long, score long"


def _search(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                d = row["d"]
                q_ids, x_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q, x = np.frombuffer(row["q"], "<i8").reshape(len(q_ids), d), np.frombuffer(row["x"], "<i8").reshape(len(x_ids), d)
                floor = np.full(len(q_ids), NO_SCORE, np.int64)
                if row["floor"] is not None:
                    known = {x["query_id"]: x["score"] for x in row["floor"]}
                    floor = np.array([known.get(int(i), NO_SCORE) for i in q_ids], np.int64)
                place, ids, scores = search_block(q, q_ids, x, x_ids, rotations[d], k, floor)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), d)), pa.array(q_ids[place]), pa.array(ids), pa.array(scores)], ["d", "query_id", "vec_id", "score"])

    return run


def top_products(queries: DataFrame, candidates: DataFrame, k: int = 5, candidate_rows: int = CANDIDATES, query_rows: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to the smaller id.

    Both tables hold vec_id and x (lists of integers). A query is not its own candidate; a repeated vec_id is a
    candidate once for each of its different vectors. Only vectors of one dimension meet; without other vectors a
    query has no rows, and an empty table gives none. Every query block meets the first candidate block of its
    dimension, which is sent to all tasks (candidate_rows vectors); the scores found are its thresholds. Later block
    pairs are compared by their longest vectors first, as rows of a few numbers; only those that can hold a better
    score bring their vectors together.
    """
    spark = candidates.sparkSession
    arrow_limits(spark)
    candidates, queries = written(candidates.distinct(), "vectors"), written(queries.distinct(), "asked")
    rotations = _rotations(candidates)
    sent = spark.sparkContext.broadcast(rotations)
    c = written(_blocks(candidates, candidate_rows, False), "blocks")
    q = written(_blocks(queries, query_rows, True).select("d", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("x").alias("q"), F.col("longest").alias("q_longest")), "queries")
    numbers = c.select("d", "block").distinct()
    first = numbers.groupBy("d").agg(F.min("block").alias("block"))
    none = F.lit(None).cast("array<struct<query_id:long,score:long>>")
    heads = c.join(F.broadcast(first), ["d", "block"])
    # One block for each dimension: of few dimensions all are sent, of many they are joined.
    opening = q.join(F.broadcast(heads) if len(rotations) <= 16 else heads, "d").withColumn("floor", none)
    opening = written(opening.select("d", "q_ids", "q", "ids", "x", "floor").mapInArrow(_search(sent, k), _FOUND), "opening")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    nth = opening.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") == k).select("d", "query_id", "score")
    # Thresholds travel with their query block: at most QUERIES of them each.
    blocks = queries.select(F.col("vec_id").alias("query_id")).distinct().withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // query_rows)))))
    floors = nth.join(blocks, "query_id").groupBy("d", "q_block").agg(F.collect_list(F.struct("query_id", "score")).alias("floor"))
    later = numbers.join(first.withColumnRenamed("block", "least"), "d").filter("block > least").select("d", "block")
    # The least threshold of a block holds only where every one of its queries has one.
    reach = q.select("d", "q_block", "q_longest", (F.octet_length("q_ids") / 8).alias("many")).join(floors, ["d", "q_block"], "left")
    least = F.when(F.size("floor") == F.col("many"), F.array_min(F.transform("floor", lambda f: f.score)))
    reach = reach.select("d", "q_block", "q_longest", least.alias("least_score"))
    numbers = c.join(later, ["d", "block"], "left_semi").select("d", "block", "longest")
    bound = F.col("q_longest") * F.col("longest") * (1 + 2 * SLACK) + 1
    near = reach.join(numbers, "d").filter(F.col("least_score").isNull() | (bound >= F.col("least_score"))).select("d", "q_block", "block")
    pairs = near.join(q.drop("q_longest"), ["d", "q_block"]).join(floors, ["d", "q_block"], "left").join(c.drop("longest"), ["d", "block"])
    pairs = pairs.repartition(F.xxhash64("d", "block", "q_block")).select("d", "q_ids", "q", "ids", "x", "floor")
    rest = pairs.mapInArrow(_search(sent, k), _FOUND)
    found = opening.union(rest).dropDuplicates().withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle_sql(every: int = 50, k: int = 5, scale: int = 256) -> str:
    return f"""
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % {every} = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
