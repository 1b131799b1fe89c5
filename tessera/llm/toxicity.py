"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as the sum of its word vector (words of the training sample) and the mean of the vectors of its
character n-grams with boundary marks, so unseen forms of a known stem still speak. The network reads overlapping
windows of WINDOW words with STEP between their starts; attention pools the states of a window into one logit, and
a document's logit is the largest of its windows. Every window of every whole text is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import fitted, labelled_sample, remainder
from tessera.llm.shared import Words, arrow_limits, long_range, mix, text_blocks

WINDOW, STEP = 32, 24
#: Bound of the training sample: documents of each class, and characters of each text.
PER_CLASS, LONGEST = 1200, 12_000
VOCABULARY, GRAMS = 20_000, 40_000
DIM, HIDDEN = 12, 8
#: Share of the clean training windows that are replaced by one of their words repeated.
REPEATED = 0.2
THRESHOLD = 0.3


def _grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams (4 and 5) of each marked word, and their offsets by word; a short word is one."""
    size = ends - starts + 2
    at = np.repeat(starts - 1, size) + long_range(size)
    first, last = np.cumsum(size) - size, np.cumsum(size) - 1
    text = low[np.clip(at, 0, max(len(low) - 1, 0))].astype(np.uint64)
    text[first], text[last] = 256, 257
    hashes, owner = [], []
    for n in (4, 5):
        runs = np.maximum(size - n + 1, 1 if n == 4 else 0)
        begin = np.repeat(first, runs) + long_range(runs)
        h = np.full(len(begin), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + text[np.minimum(begin + k, len(text) - 1)]
        hashes.append(mix(h))
        owner.append(np.repeat(np.arange(len(size)), runs))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order], np.searchsorted(owner[order], np.arange(len(size) + 1))


def windows(counts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of all windows of all texts; a text without words has none."""
    many = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STEP)), 0)
    row = np.repeat(np.arange(len(counts)), many)
    inside = long_range(many) * STEP
    return row, offsets[:-1][row] + inside, np.minimum(WINDOW, counts[row] - inside)


class _Slots:
    """Ids of hashes in a table addressed by their low bits; of two hashes in one slot the first keeps it."""

    def __init__(self, hashes: np.ndarray):
        self.size = 1 << max(4, int(len(hashes) * 8).bit_length())
        self.keys, self.ids = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32)
        slot = (hashes & np.uint64(self.size - 1)).astype(np.int64)[::-1]
        self.keys[slot], self.ids[slot] = hashes[::-1], np.arange(len(hashes), 0, -1)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """1 + position among the hashes, 0 for those that are not there."""
        slot = (wanted & np.uint64(self.size - 1)).astype(np.int64)
        return np.where(self.keys[slot] == wanted, self.ids[slot], 0)


class Vocabulary:
    """Words and n-grams that have vectors of their own: those in enough documents of the sample."""

    def __init__(self, words: np.ndarray, grams: np.ndarray):
        self.words, self.grams = words, grams
        self.word_ids, self.gram_ids = _Slots(words), _Slots(grams)

    @classmethod
    def of(cls, words: Words) -> Vocabulary:
        rows = len(words.offsets) - 1
        least = max(2, rows // 100)
        distinct, first, place = np.unique(words.hashes, return_index=True, return_inverse=True)
        row = np.repeat(np.arange(rows), np.diff(words.offsets))
        df = np.bincount(np.unique(place * rows + row) // rows, minlength=len(distinct))
        grams, at = _grams(words.low, words.starts[first], words.ends[first])
        known, which = np.unique(grams, return_inverse=True)
        gram_df = np.bincount(which, np.repeat(df, np.diff(at)), len(known))
        best = lambda x, n, limit: x[np.argsort(-n, kind="stable")[:limit]][np.sort(-n, kind="stable")[:limit] <= -least]
        return cls(best(distinct, df, VOCABULARY), best(known, gram_df, GRAMS))

    def ids(self, words: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words at `first`, those of their grams, and the grams' offsets by word."""
        grams, at = _grams(words.low, words.starts[first], words.ends[first])
        return self.word_ids(words.hashes[first]), self.gram_ids(grams), at


def _sigmoid_in(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _sigmoid_in(x.copy())


class Network:
    """The weights, forward pass and gradients. Ids are places in a table of word inputs, -1 past a window's end."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s, by=0.1: (rng.standard_normal(s) * by).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": draw(len(vocabulary.words) + 1, DIM), "gram": draw(len(vocabulary.grams) + 1, DIM), "v": draw(2 * HIDDEN), "out": draw(2 * HIDDEN + 1)}
        for d in "fb":
            self.p |= {f"W{d}": draw(DIM, 3 * HIDDEN, by=0.3), f"U{d}": draw(HIDDEN, 3 * HIDDEN, by=0.3), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.shift = 0.0

    def inputs(self, word: np.ndarray, gram: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(word):
            return np.zeros((0, DIM), np.float32)
        sums = np.add.reduceat(self.p["gram"][gram], at[:-1], axis=0)
        return self.p["word"][word] + sums / np.diff(at)[:, None]

    def _run(self, x: np.ndarray, ids: np.ndarray, d: str, keep: bool):
        """States [time, window, unit] of one direction; with keep, what the gradients need."""
        H, U = HIDDEN, self.p[f"U{d}"]
        projected = np.vstack([x @ self.p[f"W{d}"] + self.p[f"b{d}"], np.zeros((1, 3 * H), np.float32)])
        h = np.zeros((len(ids), H), np.float32)
        states, kept = np.empty((ids.shape[1], len(ids), H), np.float32), []
        steps = range(ids.shape[1]) if d == "f" else range(ids.shape[1] - 1, -1, -1)
        whole = bool((ids >= 0).all())
        for t in steps:
            g, u = projected[ids[:, t]], h @ U
            zr = _sigmoid(g[:, : 2 * H] + u[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = 2 * _sigmoid(2 * (g[:, 2 * H :] + r * u[:, 2 * H :])) - 1
            new = n + z * (h - n)
            if not whole:
                live = (ids[:, t] >= 0)[:, None]
                new = np.where(live, new, h)
            if keep:
                kept.append((t, h, z, r, n, u[:, 2 * H :]))
            h = states[t] = new
        return states, kept

    def logits(self, x: np.ndarray, ids: np.ndarray, keep: bool = False):
        f, kf = self._run(x, ids, "f", keep)
        b, kb = self._run(x, ids, "b", keep)
        H, v, out = HIDDEN, self.p["v"], self.p["out"]
        scores = f @ v[:H] + b @ v[H:]
        scores[(ids < 0).T] = -1e9
        scores -= scores.max(0)
        np.exp(scores, out=scores)
        scores /= scores.sum(0)
        value = f @ out[:H] + b @ out[H:-1]
        logit = (scores * value).sum(0) + out[-1]
        return (logit, (f, b, kf, kb, scores, value)) if keep else logit

    def gradients(self, x: np.ndarray, ids: np.ndarray, target: np.ndarray, weight: np.ndarray):
        """Gradients of the weighted logistic loss, and that of the input table."""
        H, v, out = HIDDEN, self.p["v"], self.p["out"]
        logit, (f, b, kf, kb, a, value) = self.logits(x, ids, True)
        d = (weight * (1 / (1 + np.exp(-logit)) - target)).astype(np.float32) / weight.sum()
        both = np.concatenate([f, b], 2)
        da = d * a * (value - (a * value).sum(0))
        g = {"out": np.append(np.tensordot(d * a, both, ((0, 1), (0, 1))), d.sum()).astype(np.float32), "v": np.tensordot(da, both, ((0, 1), (0, 1)))}
        dstates = (d * a)[:, :, None] * out[:-1] + da[:, :, None] * v
        dx = np.zeros((len(x), DIM), np.float32)
        for name, kept, part in (("f", kf, dstates[:, :, :H]), ("b", kb, dstates[:, :, H:])):
            W, U = self.p[f"W{name}"], self.p[f"U{name}"]
            gU, gW, gb = np.zeros_like(U), np.zeros_like(W), np.zeros(3 * H, np.float32)
            dh = np.zeros((len(ids), H), np.float32)
            at, steps = [], []
            for t, h, z, r, n, un in reversed(kept):
                dh = dh + part[t]
                live = (ids[:, t] >= 0)[:, None]
                dn = dh * (1 - z) * (1 - n * n) * live
                dz = dh * (h - n) * z * (1 - z) * live
                dr = dn * un * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r], 1)
                gU += h.T @ du
                dh = np.where(live, dh * z, dh) + du @ U.T
                at.append(ids[:, t])
                steps.append(np.concatenate([dz, dr, dn], 1))
            at, dg = np.concatenate(at), np.concatenate(steps)
            good = at >= 0
            at, dg = at[good], dg[good]
            sums = np.stack([np.bincount(at, dg[:, k], len(x)) for k in range(3 * H)], 1).astype(np.float32)
            gW, gb = x.T @ sums, dg.sum(0)
            dx += sums @ W.T
            g |= {f"U{name}": gU, f"W{name}": gW, f"b{name}": gb}
        return g, dx, logit


def _ids(place: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    at = first[:, None] + np.arange(width)
    inside = np.arange(width) < size[:, None]
    return np.where(inside, place[np.minimum(at, len(place) - 1)], -1)


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.k = p, rate, 0
        self.m, self.s = ({n: np.zeros_like(x) for n, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.k += 1
        for n, x in g.items():
            self.m[n] += 0.1 * (x - self.m[n])
            self.s[n] += 0.01 * (x * x - self.s[n])
            self.p[n] -= self.rate * (self.m[n] / (1 - 0.9**self.k)) / (np.sqrt(self.s[n] / (1 - 0.99**self.k)) + 1e-7)


def train(texts: pa.Array, labels: np.ndarray, epochs: int = 4, seed: int = 5) -> Network:
    """Fit on documents: first all windows take their document's label, then each document's highest window does.

    Without documents of both classes the network stays as drawn and every score lies near one half.
    """
    words = Words(texts)
    net = Network(Vocabulary.of(words) if len(words.hashes) else Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.uint64)), seed)
    if len(np.unique(labels)) < 2 or not len(words.hashes):
        return net
    _, at, place = np.unique(words.hashes, return_index=True, return_inverse=True)
    word, gram, grams_at = net.vocabulary.ids(words, at)
    row, first, size = windows(np.diff(words.offsets), words.offsets)
    rng, adam = np.random.default_rng(seed), _Adam(net.p, 0.01)
    ids = _ids(place, first, size, WINDOW)

    def learn(chosen: np.ndarray, weight: np.ndarray) -> None:
        # Some clean windows show one of their words all along: repetition alone is no evidence.
        same = np.flatnonzero((labels[row[chosen]] == 0) & (rng.random(len(chosen)) < REPEATED))
        shown = ids[chosen]
        shown[same] = shown[same, (rng.random(len(same)) * size[chosen[same]]).astype(np.int64)][:, None]
        used, local = np.unique(shown, return_inverse=True)
        local = local.reshape(len(chosen), WINDOW)
        if used[0] < 0:
            used, local = used[1:], local - 1
        n = np.diff(grams_at)[used]
        picked = np.repeat(grams_at[:-1][used], n) + long_range(n)
        at = np.append(0, np.cumsum(n))
        x = net.inputs(word[used], gram[picked], at)
        g, dx, _ = net.gradients(x, local, labels[row[chosen]].astype(np.float32), weight.astype(np.float32))
        spread = np.repeat(dx / n[:, None], n, axis=0)
        for name, where, grad in (("word", word[used], dx), ("gram", gram[picked], spread)):
            size_ = len(net.p[name])
            g[name] = np.stack([np.bincount(where, grad[:, k], size_) for k in range(DIM)], 1).astype(np.float32)
        adam.step(g)

    # First all windows of a document take its label: what toxic documents alone contain stands out.
    for _ in range(2):
        order = rng.permutation(len(row))
        for part in np.array_split(order, max(1, len(order) // 512)):
            learn(part, np.where(labels[row[part]] == 1, 0.5, 1.0))
    # Then only a document's highest window does; clean documents also show others of their windows.
    for k in range(epochs):
        adam.rate = 0.005 * 0.6**k
        _, _, logit = Reader(net).windows(words)
        top = np.lexsort((logit, row))
        highest = top[np.flatnonzero(np.append(row[top][1:] != row[top][:-1], True))]
        clean = np.flatnonzero(labels[row] == 0)
        chosen = np.concatenate([highest, clean[np.argsort(-logit[clean], kind="stable")[: len(highest)]], rng.choice(clean, min(len(clean), len(highest)))])
        rng.shuffle(chosen)
        for part in np.array_split(chosen, max(1, len(chosen) // 128)):
            learn(part, np.ones(len(part)))
    _, _, logit = Reader(net).windows(words)
    top = np.full(len(labels), -np.inf)
    np.maximum.at(top, row, logit)
    net.shift = _threshold(top[np.isfinite(top)], labels[np.isfinite(top)])
    return net


def _threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The logit with the fewest errors, in the middle of the gap that it lies in; it is to come out as THRESHOLD."""
    order = np.argsort(score)
    score, label = score[order], label[order]
    wrong = np.append(0, np.cumsum(label)) + np.append(np.cumsum((1 - label)[::-1])[::-1], 0)
    least = np.flatnonzero(wrong == wrong.min())
    padded = np.concatenate([[score[0] - 1], score, [score[-1] + 1]])
    k = least[np.argmax(padded[least + 1] - padded[least])]
    return float((padded[k] + padded[k + 1]) / 2)


class Reader:
    """The network's forward pass over many windows, with a bounded cache of word inputs and no fresh arrays in the loop."""

    SLOTS = 1 << 17
    BATCH = 1024

    def __init__(self, net: Network):
        self.net, H = net, HIDDEN
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.parts = {}
        scale = np.array([1, 1, 2], np.float32)  # tanh(x) is 2 * sigmoid(2 * x) - 1
        for d in "fb":
            cut = lambda m: [np.ascontiguousarray(x * s) for x, s in zip(np.split(m, 3, axis=-1), scale)]  # noqa: B023, E731
            self.parts[d] = cut(net.p[f"W{d}"]), cut(net.p[f"U{d}"]), cut(net.p[f"b{d}"])
        self.table = np.zeros((6, self.SLOTS, H), np.float32)
        self.x, self.u = (np.zeros((3, self.BATCH, H), np.float32) for _ in range(2))
        self.states = np.zeros((2, WINDOW, self.BATCH, H), np.float32)

    def places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The row of each word in the returned tables [part, row, unit] of projected inputs."""
        slot = (words.hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != words.hashes)
        if not len(missing):
            return slot, self.table
        new, at, back = np.unique(words.hashes[missing], return_index=True, return_inverse=True)
        word, gram, offsets = self.net.vocabulary.ids(words, missing[at])
        x = self.net.inputs(word, gram, offsets)
        rows = np.stack([x @ W + b for d in "fb" for W, b in zip(self.parts[d][0], self.parts[d][2])])
        place = (new & np.uint64(self.SLOTS - 1)).astype(np.int64)
        # A word of this block may not lose its slot to another while the block is read: losers stand behind the cache.
        taken = np.zeros(self.SLOTS, bool)
        taken[slot[self.keys[slot] == words.hashes]] = True
        _, winner = np.unique(place, return_index=True)
        wins = np.zeros(len(new), bool)
        wins[winner] = True
        wins &= ~taken[place]
        self.keys[place[wins]], self.table[:, place[wins]] = new[wins], rows[:, wins]
        place[~wins] = self.SLOTS + np.arange(int((~wins).sum()))
        slot[missing] = place[back]
        return slot, np.concatenate([self.table, rows[:, ~wins]], 1) if not wins.all() else self.table

    def logits(self, ids: np.ndarray, table: np.ndarray) -> np.ndarray:
        B, T = ids.shape
        H, v, out = HIDDEN, self.net.p["v"], self.net.p["out"]
        ids = np.ascontiguousarray(ids.T)
        whole = bool((ids >= 0).all())
        live = (ids >= 0)[:, :, None]
        for k, d in enumerate("fb"):
            U, states = self.parts[d][1], self.states[k]
            tables = table[3 * k : 3 * k + 3]
            x, u = self.x[:, :B], self.u[:, :B]
            h = np.zeros((B, H), np.float32)
            for t in range(T) if d == "f" else range(T - 1, -1, -1):
                for j in range(3):
                    np.take(tables[j], ids[t], axis=0, out=x[j], mode="clip")
                    np.matmul(h, U[j], out=u[j])
                _sigmoid_in(np.add(x[0], u[0], out=x[0]))
                _sigmoid_in(np.add(x[1], u[1], out=x[1]))
                u[2] *= x[1]
                n = _sigmoid_in(np.add(x[2], u[2], out=x[2]))
                n *= 2
                n -= 1
                new = states[t][:B]
                np.subtract(h, n, out=new)
                new *= x[0]
                new += n
                if not whole:
                    np.copyto(new, h, where=~live[t])
                h = new
        f, b = self.states[0, :T, :B], self.states[1, :T, :B]
        scores = f @ v[:H] + b @ v[H:]
        if not whole:
            scores[~live[:, :, 0]] = -1e9
        scores -= scores.max(0)
        np.exp(scores, out=scores)
        value = f @ out[:H] + b @ out[H:-1]
        return (scores * value).sum(0) / scores.sum(0) + out[-1]

    def windows(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, logit) of every window."""
        row, first, size = windows(np.diff(words.offsets), words.offsets)
        place, table = self.places(words)
        out = np.empty(len(first), np.float64)
        order = np.argsort(-size, kind="stable")
        for k in range(0, len(order), self.BATCH):
            part = order[k : k + self.BATCH]
            out[part] = self.logits(_ids(place, first[part], size[part], int(size[part[0]])), table)
        return row, first, out


def score_texts(reader: Reader, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, windows, first word of the highest window) of each text; without words the score is that of no evidence."""
    words = Words(texts)
    rows = len(texts)
    scores, many, where = np.full(rows, -8.0), np.zeros(rows, np.int64), np.full(rows, -1, np.int64)
    if len(words.hashes):
        row, first, logit = reader.windows(words)
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        scores[row[begin]] = np.maximum.reduceat(logit, begin) - reader.net.shift
        order = np.lexsort((-first, logit, row))
        top = order[np.append(begin[1:], len(row)) - 1]
        where[row[top]] = first[top] - words.offsets[:-1][row[top]]
        many = np.bincount(row, minlength=rows)
    cut = np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(scores + cut, -700, 700))), many, where


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(pickle.loads(sent.value))
        for batch in text_blocks(batches, "text"):
            score, many, where = score_texts(reader, batch.column("text"))
            more = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in more), pa.array(score), pa.array(many), pa.array(where)], [*more, "score", "n_windows", "worst_word"])

    return run


def fit(docs: DataFrame, labels: DataFrame, learn=None, per_class: int = PER_CLASS) -> Network:
    """Train on a bounded sample (per_class documents of each class) of the labelled rows that `learn` admits."""
    sample = labelled_sample(docs, labels, "toxic", F.lit(True) if learn is None else learn, per_class, LONGEST)
    return fitted(sample, train)


def toxicity(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score (0 to 1), n_windows and worst_word (place of the highest window, -1 without words) for each row.

    Null and blank texts have no windows and a score near 0. Repeated rows are scored alike; other columns are not
    read. An empty table gives no rows. Scores of THRESHOLD and more count as toxic.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    sent = spark.sparkContext.broadcast(pickle.dumps(net))
    return docs.select("doc_id", "text").mapInArrow(_score(sent), "doc_id long, score double, n_windows long, worst_word long")


def clean_documents(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns, in one pass and without a join."""
    spark = docs.sparkSession
    arrow_limits(spark)
    sent = spark.sparkContext.broadcast(pickle.dumps(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(pickle.loads(sent.value))
        for batch in text_blocks(batches, "text"):
            yield batch.filter(pa.array(score_texts(reader, batch.column("text"))[0] < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every document by a network that has learnt from rows with crc32(doc_id) mod 4 other than 2."""
    net = fit(docs, labels, remainder("doc_id", 4) != 2)
    out = toxicity(docs, net)
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_windows", "worst_word")
