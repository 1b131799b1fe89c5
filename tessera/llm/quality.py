"""Document quality by Bradley-Terry ranking: pairwise preferences, logistic loss on feature differences.

Features describe a text's form (shares of byte classes, repetition, word shapes, frequent bytes and hashed words);
measures enter through their quantile steps, so the linear score can bend. A pair prefers a good document to a poor one.
The score's threshold is that quantile of the training scores that the poor documents' share gives.

All labelled rows are learnt from: they are measured once and dealt to tasks, which train on pairs of their own rows;
after each round the tasks' weights are averaged. Quantiles are exact, found digit by digit from counts over all rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import remainder
from tessera.llm.shared import Words, arrow_limits, release, text_blocks, written

#: Pairs that small corpora are gone over for; larger ones give as many as their larger class, in each round.
PAIRS, ROUNDS = 60_000, 4
#: Rows of a training task, rows that are paired among each other, and rows of the smaller class in a task at least:
#: where the class has fewer, its rows are sent to several tasks.
TASK_ROWS, PAIRED, PARTNERS = 20_000, 4096, 64
#: Bits of a number that each pass of a quantile settles.
DIGITS = (12, 10, 10, 8, 8, 8, 8)
STEPS = 12
HASHED = 512
THRESHOLD = 0.3

_KIND = np.full(256, 6)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 4, 5
_KIND[[44, 46, 39, 45, 58, 59, 63]] = 7


def measures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(dense measures, counts of hashed words as shares) of each text; an empty text has zeros throughout."""
    words = Words(texts)
    rows = len(texts)
    n = np.maximum(np.diff(words.rows), 1).astype(np.float64)
    owner = np.repeat(np.arange(rows), np.diff(words.rows))
    many = np.diff(words.offsets)
    m = np.maximum(many, 1).astype(np.float64)
    word_row = np.repeat(np.arange(rows), many)
    out = []
    kinds = np.bincount(owner * 8 + _KIND[words.raw], minlength=8 * rows).reshape(rows, 8)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 3], 1)
    out += [kinds[:, k] / n for k in range(8)] + [kinds[:, 1] / letters, kinds[:, 6] / m, kinds[:, 7] / m]
    for byte in b"|!%$&*#<>{}=+\\/_@":
        out.append(np.bincount(owner[words.raw == byte], minlength=rows) / m)
    length = (words.ends - words.starts).astype(np.float64)
    out += [np.bincount(word_row, length, rows) / m, np.sqrt(np.bincount(word_row, length**2, rows) / m), np.log1p(many)]
    h = words.hashes
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (word_row[1:] == word_row[:-1])
    out.append(np.bincount(word_row, same, rows) / m)
    for step in (1, 3):
        gram = h.copy()
        for k in range(1, step):
            gram[:-k] = gram[:-k] * np.uint64(31) + h[k:]
        order = np.lexsort((gram, word_row))
        g, r = gram[order], word_row[order]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        out.append(np.bincount(r[first], minlength=rows) / m)
        out.append(np.bincount(r[first], minlength=rows) / np.sqrt(m))
        runs = np.diff(np.append(np.flatnonzero(first), len(g)))
        most = np.zeros(rows)
        np.maximum.at(most, r[first], runs)
        out.append(most / m)
    if len(h):
        final = words.raw[words.ends - 1]
        odd = (_KIND[final] == 6) | (_KIND[final] == 2)
        out.append(np.bincount(word_row, odd, rows) / m)
        upper = _KIND[words.raw[words.starts]] == 1
        out.append(np.bincount(word_row, upper, rows) / m)
        twice = np.zeros(len(h), bool)
        twice[length > 1] = words.raw[words.ends[length > 1] - 1] == words.raw[words.ends[length > 1] - 2]
        out.append(np.bincount(word_row, twice, rows) / m)
        out.append(np.bincount(word_row, length == 1, rows) / m)
    else:
        out += [np.zeros(rows)] * 4
    hashed = np.bincount(word_row * HASHED + (h >> np.uint64(40)).astype(np.int64) % HASHED, minlength=rows * HASHED).reshape(rows, HASHED)
    return np.stack(out, 1), np.sqrt(hashed / m[:, None]).astype(np.float32)


class Ranking:
    """Weights of the Bradley-Terry score."""

    def __init__(self, steps: np.ndarray, weights: np.ndarray, cut: float, spread: float):
        self.steps, self.weights, self.cut, self.spread = steps, weights, cut, spread

    def features(self, dense: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        over = (dense[:, None, :] > self.steps[None]).reshape(len(dense), -1)
        return np.concatenate([over, hashed], 1, dtype=np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """0 to 1; the threshold quantile comes out as THRESHOLD."""
        raw = self.features(*measures(texts)) @ self.weights
        level = (raw - self.cut) / self.spread + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(level.astype(np.float64), -700, 700)))


def learn(x: np.ndarray, labels: np.ndarray, w: np.ndarray, speed: np.ndarray, times: int, rng: np.random.Generator) -> int:
    """Steps of w over pairs of rows of x, in place; each row is in `times` pairs at least. Returns the pairs."""
    good, poor, rate = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0), 0.05
    many = max(len(good), len(poor))
    for _ in range(times):
        a, b = (np.concatenate([rng.permutation(side) for _ in range(-(-many // len(side)))])[:many] for side in (good, poor))
        for k in range(0, many, 200):
            d = x[a[k : k + 200]] - x[b[k : k + 200]]
            g = -(d.T @ (1 / (1 + np.exp(d @ w)))) / len(d) + 1e-4 * w
            speed += g * g
            w -= rate * g / np.sqrt(speed)
    return many * times


def _times(good: int, poor: int, pairs: int, rounds: int) -> int:
    return max(1, -(-pairs // (rounds * max(good, poor))))


def _untrained(label: int | None) -> Ranking:
    """What rows of one class, or none, teach: all weights are zero."""
    width = measures(pa.array(["x"]))[0].shape[1]
    return Ranking(np.zeros((STEPS, width)), np.zeros(STEPS * width + HASHED, np.float32), -1.0 if label == 1 else 0.0, 1.0)


def _start(steps: np.ndarray) -> tuple[Ranking, np.ndarray]:
    w = np.zeros(steps.size + HASHED, np.float32)
    return Ranking(steps, w, 0.0, 1.0), np.full(len(w), 1e-6, np.float32)


def train(texts: pa.Array, labels: np.ndarray, pairs: int = PAIRS, rounds: int = ROUNDS, seed: int = 11) -> Ranking:
    """Fit on the texts in this process, as a single task of `fit` would. Without documents of both classes all weights
    stay zero."""
    if len(np.unique(labels)) < 2:
        return _untrained(int(labels[0]) if len(labels) else None)
    dense, hashed = (np.concatenate(x) for x in zip(*(measures(texts.slice(k, 256)) for k in range(0, len(texts), 256))))
    model, speed = _start(np.sort(dense, 0)[_ranks(len(dense))])
    x, n_poor = model.features(dense, hashed), int((labels == 0).sum())
    for k in range(rounds):
        learn(x, labels, model.weights, speed, _times(len(labels) - n_poor, n_poor, pairs, rounds), np.random.default_rng(seed + k))
    raw = np.sort(x @ model.weights)
    model.cut, model.spread = float((raw[n_poor - 1] + raw[n_poor]) / 2), float(max(raw.std() / 4, 1e-3))
    return model


def _ranks(n: int) -> np.ndarray:
    return np.rint(np.linspace(0.02, 0.98, STEPS) * (n - 1)).astype(np.int64)


def _digits(shift: int, wanted: list[np.ndarray] | None, bits: int):
    """(column, leading bits, rows) of the numbers whose bits before those, `bits` fewer, are among the column's wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            u = np.concatenate(held)
            held.clear()
            for c in range(u.shape[1]):
                lead = u[:, c] >> np.uint64(shift)
                if wanted is not None:
                    lead = lead[np.isin(lead >> np.uint64(bits), wanted[c])]
                value, n = np.unique(lead, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c)), pa.array(value.view(np.int64)), pa.array(n)], ["place", "lead", "n"])

        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("dense").to_pylist())).reshape(batch.num_rows, -1) + 0.0
                u = x.view(np.uint64)
                held.append(np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63)))  # in the numbers' order
            if sum(map(len, held)) > 20_000:
                yield from flush()
        if held:
            yield from flush()

    return run


def order_statistics(rows: DataFrame, ranks: np.ndarray) -> np.ndarray:
    """The numbers of the given ranks (from 0) in each place of the binary column `dense` (doubles): [rank, place].

    Each pass counts, over all rows, the next DIGITS of the numbers that share the digits found so far."""
    shift, wanted, lead, left = 64, None, None, None
    for bits in DIGITS:
        shift -= bits
        counted = rows.select("dense").mapInArrow(_digits(shift, wanted, bits), "place long, lead long, n long")
        found = counted.groupBy("place", "lead").agg(F.sum("n").alias("n")).toArrow()
        place, value, n = found["place"].to_numpy(), found["lead"].to_numpy().view(np.uint64), found["n"].to_numpy()
        if lead is None:
            left = np.repeat(np.asarray(ranks)[:, None], place.max() + 1, 1)
            lead = np.zeros(left.shape, np.uint64)
        for c in range(left.shape[1]):
            mine = np.flatnonzero(place == c)
            mine = mine[np.argsort(value[mine])]
            for r in range(len(left)):
                own = mine if wanted is None else mine[value[mine] >> np.uint64(bits) == lead[r, c]]
                upto = np.cumsum(n[own])
                k = int(np.searchsorted(upto, left[r, c], "right"))
                left[r, c] -= upto[k] - n[own[k]]
                lead[r, c] = value[own[k]]
        wanted = [np.unique(lead[:, c]) for c in range(lead.shape[1])]
    return np.where(lead >> np.uint64(63), lead ^ np.uint64(1 << 63), ~lead).view(np.float64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_blocks(batches, "text"):
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            dense, hashed = ([x.tobytes() for x in side] for side in measures(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(dense, pa.binary()), pa.array(hashed, pa.binary())], ["doc_id", "label", "dense", "hashed"])


def _features(model: Ranking, batch: pa.RecordBatch) -> np.ndarray:
    side = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1)
    return model.features(side("dense", np.float64), side("hashed", np.float32))


def _round(sent, times: int, seed: int):
    """A task's weights and step sizes after a pass over its rows, and its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, speed = pickle.loads(sent.value)
        model.weights, speed, rng, pairs = model.weights.copy(), speed.copy(), np.random.default_rng(seed), 0
        xs, labels, n = [], [], 0

        def pair() -> int:
            nonlocal xs, labels, n
            y = np.concatenate(labels) if labels else np.zeros(0, int)
            if len(np.unique(y)) < 2:
                return 0  # held until rows of the other class come
            x, xs, labels, n = np.concatenate(xs), [], [], 0
            return learn(x, y, model.weights, speed, times, rng)

        for batch in batches:
            if batch.num_rows:
                xs.append(_features(model, batch))
                labels.append(batch.column("label").to_numpy())
                n += batch.num_rows
            if n >= PAIRED:
                pairs += pair()
        pairs += pair()
        release()
        if pairs:
            both = np.concatenate([model.weights, speed]).astype(np.float64) * pairs
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([pairs]), pa.array([both.tobytes()], pa.binary())], ["all", "pairs", "weights"])

    return run


def _averaged(rows: pa.Table) -> pa.Table:
    total, both = 0, 0.0
    for n, blob in sorted(zip(rows["pairs"].to_pylist(), rows["weights"].to_pylist())):
        total, both = total + n, both + np.frombuffer(blob)
    return pa.table({"weights": pa.array([(both / total).astype(np.float32).tobytes()], pa.binary())})


def _raw(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = pickle.loads(sent.value)
        for batch in batches:
            if batch.num_rows:
                raw = (_features(model, batch) @ model.weights).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array([x.tobytes() for x in raw], pa.binary())], ["raw", "dense"])

    return run


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for batch in text_blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text")))], ["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, learn=None, pairs: int = PAIRS, rounds: int = ROUNDS, task_rows: int = TASK_ROWS, seed: int = 11) -> Ranking:
    """Train on every row of docs whose label `learn` admits, texts of any length and null texts among them.

    A document with labels of both kinds counts as good; other labels and nulls are left out. The threshold leaves as
    many of those rows below it as are poor. The driver holds the weights and counts of bounded number only.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    learn = F.lit(True) if learn is None else learn
    marked = labels.filter(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    known = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    tasks = max(1, math.ceil(sum(known.values()) / task_rows))
    least = min(known, key=known.get, default=0)
    copies = min(tasks, max(1, math.ceil(PARTNERS * tasks / known.get(least, 1))))
    # Labels grow with the documents: they are never broadcast.
    rows = docs.select("doc_id", "text").join(marked.hint("merge"), "doc_id").mapInArrow(_measure, "doc_id long, label int, dense binary, hashed binary")
    sent_to = F.explode(F.when(F.col("label") == least, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("again", sent_to).withColumn("task", F.pmod(F.xxhash64("doc_id") + F.col("again"), F.lit(tasks)))
    rows = rows.repartition(tasks, "task").sortWithinPartitions("task", F.xxhash64("doc_id", F.lit(5)), "dense")
    rows = written(rows.select("label", "again", "dense", "hashed"), "measures")
    once = rows.filter("again = 0")
    n, good = once.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if good in (0, n):
        return _untrained(1 if good else 0)
    model, speed = _start(order_statistics(once, _ranks(n)))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(pickle.dumps((model, speed)))
        ends = rows.select("label", "dense", "hashed").mapInArrow(_round(sent, _times(good, n - good, pairs, rounds), seed + k), "all long, pairs long, weights binary")
        both = ends.groupBy("all").applyInArrow(_averaged, "weights binary").collect()
        if both:
            model.weights, speed = np.split(np.frombuffer(both[0]["weights"], np.float32), 2)
        sent.destroy()
    sent = spark.sparkContext.broadcast(pickle.dumps((model, speed)))
    raw = written(once.select("dense", "hashed").mapInArrow(_raw(sent), "raw double, dense binary"), "raw")
    sent.destroy()
    model.cut = float(order_statistics(raw, np.array([n - good - 1, n - good])).mean())
    model.spread = float(max(raw.agg(F.stddev_pop("raw")).first()[0] / 4, 1e-3))
    return model


def quality(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id and score (0 to 1) for each row of docs; THRESHOLD and more counts as good.

    Null and blank texts are scored by their zero measures. Repeated rows are scored alike; other columns are not
    read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    sent = spark.sparkContext.broadcast(pickle.dumps(model))
    return docs.select("doc_id", "text").mapInArrow(_score(sent), "doc_id long, score double")


def good_documents(docs: DataFrame, model: Ranking, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more, with all their columns, in one pass and without a join."""
    spark = docs.sparkSession
    arrow_limits(spark)
    sent = spark.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = pickle.loads(sent.value)
        for batch in text_blocks(batches, "text"):
            yield batch.filter(pa.array(ranking.scores(batch.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every document by a ranking that has learnt from rows with crc32(doc_id) mod 5 other than 0."""
    model = fit(docs, labels, remainder("doc_id", 5) != 0)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return quality(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
