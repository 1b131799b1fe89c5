"""Log-probabilities of texts from a causal self-attention model on subword ids, trained in numpy.

A text is its words, lower-cased and parted by white space, then an end. Words are encoded into subwords by a public
vocabulary; a text's probability is the product of its subwords' and its end's. One attention layer reads windows of
CONTEXT subwords that overlap by OVERLAP; each subword is scored once, in the window where it has the longer past, in
batches with a causal mask. The output is a softmax in two steps, both made from the state: a class of subwords, then
the subword within its class. Subwords without vectors of their own share one class, where counts decide.

The network learns from every training document. All texts are encoded once, also where they are scored afterwards;
subwords are counted, and what stands around them, over all training texts, which ranks the subwords and forms their
classes. Each task then trains on whole texts of
its part, and after each round the weights of all tasks are averaged, slice by slice. Rounds part a large corpus between
them, so that each subword is learnt from once; small corpora are gone over in every round.

Word counts, for the base score, come from all training documents as well. Frequent words' counts (a fixed number of them)
travel to the tasks; the others are joined by a hash of the word, so nothing that grows with the corpus is held in one
place.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import remainder
from tessera.llm.shared import BLOCK, Words, arrow_limits, long_range, release, text_blocks, written
from tessera.llm.token_counts import VOCABULARIES, encoding

CONTEXT, OVERLAP = 32, 8
DIM, HIDDEN, CLASSES = 16, 32, 64
#: Words whose counts are sent to every task, 16 bytes each.
HEAD_WORDS = 100_000
#: Documents that a round goes over at least, if there are as many; each is in one round at least.
LEAST_DOCUMENTS = 1440
#: Documents of a training task, and rounds of training between which weights are averaged.
TASK_DOCUMENTS, ROUNDS = 2400, 4
#: Windows of a training step: where one task learns, and where the averages of several smooth the steps besides.
STEP, WIDE_STEP = 128, 512
#: Steps of the hash that deals documents to rounds.
DEALT = 1 << 20
#: Weights or counts in one slice of the exchange that adds them up.
SLICE = 4096
#: Frequent subwords whose neighbourhood tells classes apart, and subwords whose neighbours are counted at once.
WIDTH, NEAR_BLOCK = 256, 1 << 19
#: Windows and rows that are worked on at once, so that what is made of them stays near the processor.
NEAR_WINDOWS, NEAR_ROWS = 64, 2048
#: Bytes of a word that are encoded at once; longer words are encoded in pieces. Shorter ones go so many to a call.
PIECE, TOGETHER = 256, 20_000
#: White space of the vocabulary's pattern that does not part words here. Fixed value.
_INNER_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_END = 50256
#: Main axes that classes are cut along.
AXES = 24
#: Subwords with vectors of their own.
KNOWN = 4095
_VOCAB = 50257


_SCALE = np.float32(1 / math.sqrt(DIM))
_PAST = np.tril(np.ones((CONTEXT, CONTEXT), np.float32))
_ONES = np.ones(CLASSES, np.float32)

#: Hash that stands for the end of a text.
END_HASH = np.uint64(0x5EED0FE2D0F7E875)


@lru_cache(4)
def _opening(folder: str) -> np.ndarray:
    """Which subwords begin with a blank: in words parted by single blanks, those that begin a word."""
    encoder = encoding(folder)
    return np.array([encoder.decode_single_token_bytes(i).startswith(b" ") for i in range(_END)])


class Spelling:
    """Subword ids of words, remembered for a bounded number of words: beyond it only the last texts' words stay."""

    LIMIT = 300_000

    def __init__(self, folder: str):
        self.encode, self.opening = encoding(folder).encode_ordinary, _opening(folder)
        # Hashes of the words in order, and where the subwords of each lie in `flat`.
        self.hashes, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _alone(self, word: bytes) -> np.ndarray:
        text = word.decode("utf-8", "replace")
        return np.array([i for j in range(0, len(text), PIECE) for i in self.encode((" " if j == 0 else "") + text[j : j + PIECE])], np.int32)

    def _joined(self, words: Words, which: np.ndarray) -> str:
        """The words with a blank before each."""
        first, n = words.starts[which], words.ends[which] - words.starts[which]
        out = np.full(int(n.sum()) + len(n), 32, np.uint8)
        inside = long_range(n)
        out[np.repeat(np.cumsum(n + 1) - n, n) + inside] = words.low[np.repeat(first, n) + inside]
        return out.tobytes().decode("utf-8", "replace")

    def spell(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subwords of some of the words: a flat array, and each word's start and number in it. Words are encoded many at
        once: the pattern parts them at the blanks before them, so they have the same subwords as one by one. Long words,
        and those with white space of the pattern inside, go alone."""
        parts, total = [], 0
        start, size = (np.zeros(len(which), np.int64) for _ in range(2))
        for s in range(0, len(which), TOGETHER):
            place = np.arange(s, min(s + TOGETHER, len(which)))
            plain = words.ends[which[place]] - words.starts[which[place]] <= PIECE
            text = self._joined(words, which[place[plain]])
            if _INNER_BLANK.search(text):
                plain[plain] = [not _INNER_BLANK.search(words.word(k).decode("utf-8", "replace")) for k in which[place[plain]]]
                text = self._joined(words, which[place[plain]])
            ids = np.array(self.encode(text), np.int32)
            edges = np.append(np.flatnonzero(self.opening[ids]), len(ids))
            if len(edges) != plain.sum() + 1:
                raise ValueError("words of one call were not parted at their blanks")
            start[place[plain]], size[place[plain]] = total + edges[:-1], np.diff(edges)
            parts.append(ids)
            total += len(ids)
            for k in place[~plain]:
                parts.append(self._alone(words.word(which[k])))
                start[k], size[k] = total, len(parts[-1])
                total += len(parts[-1])
        return np.concatenate([np.zeros(0, np.int32), *parts]), start, size

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(subword ids of all words in order, subwords of each word)."""
        if not len(words.hashes):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        coded = pa.array(words.hashes).dictionary_encode()
        place, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        at = np.searchsorted(self.hashes, distinct)
        new = np.flatnonzero(np.append(self.hashes, np.uint64(0))[at] != distinct) if len(self.hashes) else np.arange(len(distinct))
        at[new] = len(self.hashes) + np.arange(len(new))
        first = np.empty(len(distinct), np.int64)
        first[place[::-1]] = np.arange(len(place) - 1, -1, -1)
        flat, start, size = self.spell(words, first[new])
        start, size = np.append(self.start, start + len(self.flat)), np.append(self.size, size)
        flat = np.append(self.flat, flat)
        n = size[at[place]]
        out = flat[np.repeat(start[at[place]], n) + long_range(n)]
        hashes = np.append(self.hashes, distinct[new])
        if len(hashes) > self.LIMIT:
            hashes, start, size = distinct, start[at], size[at]
            flat, start = flat[np.repeat(start, size) + long_range(size)], np.cumsum(size) - size
        order = np.argsort(hashes)
        self.hashes, self.start, self.size, self.flat = hashes[order], start[order], size[order], flat
        return out, n


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's word counts: at most one row a word for a few million words at once."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["word", "n"])

    held, n = [], 0
    for batch in text_blocks(batches, "text"):
        held.append(Words(batch.column("text")).hashes)
        # The end of each text is a token too.
        held.append(np.full(batch.num_rows, END_HASH, np.uint64))
        n += len(held[-2])
        if n > 5_000_000:
            yield flush(held)
            held, n = [], 0
    if held:
        yield flush(held)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, n) over all tokens of docs, ends included."""
    arrow_limits(docs.sparkSession)
    counted = docs.select("text").mapInArrow(_count_words, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def sequences(words: Words, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of each text with its end: one flat array and the offsets of the texts."""
    rows = len(words.offsets) - 1
    total = np.append(0, np.cumsum(sizes))[words.offsets]
    out = np.full(len(ids) + rows, _END, np.int32)
    row = np.repeat(np.arange(rows), np.diff(total))
    out[np.arange(len(ids)) + row] = ids
    return out, total + np.arange(rows + 1)


def spans(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, scored from, end) of the windows: OVERLAP of each, after the first, is past that was scored before."""
    n = np.diff(offsets)
    step = CONTEXT - OVERLAP
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - CONTEXT) // step)), 0)
    row = np.repeat(np.arange(len(n)), many)
    k = long_range(many)
    first = offsets[:-1][row] + k * step
    end = np.minimum(first + CONTEXT, offsets[1:][row])
    return first, np.where(k == 0, first, first + OVERLAP), end


def ranked(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent subwords, at most KNOWN, and each subword's place among them from 1 (0: none)."""
    top = np.argsort(-counts, kind="stable")[: min(KNOWN, int((counts > 0).sum()))]
    known = np.zeros(len(counts), np.int32)
    known[top] = np.arange(1, len(top) + 1)
    return top, known


def neighbours(flat: np.ndarray, known: np.ndarray, n_top: int) -> np.ndarray:
    """How often each of the WIDTH most frequent subwords stands before a subword, and near it otherwise: counts of
    [place of the subword, column], flat."""
    width, steps = min(n_top, WIDTH), (1, -1, *range(2, 13))
    out = np.zeros((n_top + 1) * 2 * width, np.int64)
    for first in range(0, len(flat), NEAR_BLOCK):
        x = known[flat[first : first + NEAR_BLOCK]].astype(np.int64)
        there = np.flatnonzero((x > 0) & (x <= width))
        # Rows of the subwords, with rows of none before and behind; what falls on none is dropped at the end.
        rows = np.zeros(len(x) + 1 + max(steps), np.int64)
        np.multiply(x, 2 * width, out=rows[1 : len(x) + 1])
        column = x[there] - 1
        cells = np.empty((len(steps), len(there)), np.int64)
        for found, step in zip(cells, steps):
            np.add(rows[1 + step :].take(there) if step > -1 else rows.take(there), column, out=found)
            if step != 1:
                found += width
        out += np.bincount(cells.ravel(), minlength=len(out))
    out[: 2 * width] = 0
    return out


def _classes(mass: np.ndarray, top: np.ndarray, around: np.ndarray) -> np.ndarray:
    """A class for each subword: halves of nearly equal mass, cut again and again along the main axis of what stands
    around the subwords in the training texts. Subwords outside `top` follow in the last class."""
    around = around.reshape(len(top) + 1, -1).astype(np.float64)
    around = np.sqrt(around[1:])
    around /= np.maximum(np.sqrt((around**2).sum(1, keepdims=True)), 1e-9)
    weight = mass[top] / mass[top].sum() if len(top) else mass[top]
    # A few main axes of all subwords hold what the cuts need.
    spread = around - weight @ around
    around = spread @ np.linalg.eigh((spread * weight[:, None]).T @ spread)[1][:, -AXES:]
    out = np.full(len(mass), CLASSES - 1)
    parts = [np.arange(len(top))]
    while len(parts) < CLASSES - 1:
        k = max(range(len(parts)), key=lambda j: weight[parts[j]].sum() if len(parts[j]) > 1 else -1)
        part = parts.pop(k)
        if len(part) < 2:
            parts.append(part)
            break
        w = weight[part][:, None]
        y = around[part] - (around[part] * w).sum(0) / w.sum()
        axis = np.linalg.eigh((y * w).T @ y)[1][:, -1]
        order = np.argsort(y @ axis, kind="stable")
        cut = int(np.clip(np.searchsorted(np.cumsum(w[order, 0]), w.sum() / 2), 1, len(part) - 1))
        parts += [part[order[:cut]], part[order[cut:]]]
    for k, part in enumerate(parts):
        out[top[part]] = k
    return out


def _exp(x: np.ndarray, most: float) -> np.ndarray:
    """e to the power of x in its place, of `most` where x is larger."""
    if x.size and x.max() > most:
        np.minimum(x, most, out=x)
    return np.exp(x, out=x)


def _turned(x: np.ndarray) -> np.ndarray:
    """The matrices of x turned over, laid out anew: products of small ones take a fraction of the time then."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


class Model:
    """One layer of causal attention with tables for the subwords it knows; others share one entry."""

    def __init__(self, counts: np.ndarray, around: np.ndarray, seed: int = 7):
        """counts: the training texts' subwords, which rank them; around: their `neighbours`, which form classes."""
        counts = counts.astype(np.float64)
        rng = np.random.default_rng(seed)
        draw = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        smooth = (counts + 0.1) / (counts.sum() + 0.1 * len(counts))
        top, self.known = ranked(counts)
        self.classes = _classes(smooth, top, around)
        # Rows of the tables lie class by class, so that a class is a slice; row 0 stands for all others.
        top = top[np.argsort(self.classes[top], kind="stable")]
        self.known[top] = np.arange(1, len(top) + 1)
        edges = np.searchsorted(self.classes[top], np.arange(CLASSES)) + 1
        self.slices = list(zip(edges[:-1].tolist(), edges[1:].tolist()))  # without the class of all others
        mass = np.bincount(self.classes, smooth, CLASSES)
        self.other = np.log(smooth / mass[self.classes]).astype(np.float32)
        inside = np.append(0, self.other[top]).astype(np.float32)
        e = DIM
        self.p = {"E": draw(len(top) + 1, e, by=0.1), "P": draw(CONTEXT, e, by=0.1), **{k: draw(e, e, by=0.25) for k in "qkvo"}, "A": draw(e, HIDDEN, by=0.25), "a": np.zeros(HIDDEN, np.float32), "B": draw(HIDDEN, e, by=0.2), "C": draw(e, CLASSES, by=0.1), "c": np.log(np.maximum(mass, 1e-6)).astype(np.float32), "D": draw(len(top) + 1, e, by=0.1), "d": inside}

    def vector(self) -> np.ndarray:
        """All weights, one after the other."""
        return np.concatenate([x.ravel() for x in self.p.values()])

    def take(self, vector: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = vector[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def state(self, x: np.ndarray):
        """The state after each position of windows of known-table ids [window, position], and what the gradients need."""
        p, (n, t) = self.p, x.shape
        h = p["E"].take(x, axis=0)
        h += p["P"][:t]
        h = h.reshape(n * t, -1)
        qkv = np.empty((n * t, 3 * DIM + 1), h.dtype)
        np.matmul(h, np.concatenate([p["q"] * _SCALE, p["k"], p["v"]], 1), out=qkv[:, :-1])
        qkv[:, -1] = 1
        q, k, v = (c.reshape(n, t, -1) for c in (qkv[:, :DIM], qkv[:, DIM : 2 * DIM], qkv[:, 2 * DIM :]))
        w = q @ _turned(k)
        _exp(w, 60)
        w *= _PAST[:t, :t]
        # The last column of v is 1, so that the product holds the sums of the weights.
        z = (w @ v).reshape(n * t, -1)
        part = 1 / z[:, -1:]
        z = z[:, :-1] * part
        m = h + z @ p["o"]
        g = m @ p["A"]
        g += p["a"]
        np.maximum(g, 0, out=g)
        return (m + g @ p["B"]).reshape(n, t, -1), (h, q, k, v, w, part, z, m, g)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of all subwords after each position [window, position, subword]."""
        y, _ = self.state(x)
        s = y @ self.p["C"] + self.p["c"]
        s = s - np.log(np.exp(s - s.max(-1, keepdims=True)).sum(-1, keepdims=True)) - s.max(-1, keepdims=True)
        out = np.repeat(self.other[None, None], x.shape[0], 0).repeat(x.shape[1], 1).astype(np.float64)
        for first, last in self.slices:
            if first == last:
                continue
            u = y @ self.p["D"][first:last].T + self.p["d"][first:last]
            u -= np.log(np.exp(u).sum(-1, keepdims=True))
            out[:, :, np.flatnonzero((self.known >= first) & (self.known < last))[np.argsort(self.known[(self.known >= first) & (self.known < last)])]] = u
        return out + s[:, :, self.classes]

    def back(self, x: np.ndarray, dy: np.ndarray, saved: tuple) -> dict:
        """Gradients of the weights behind the states of `state`, dy those of the states [window * position]."""
        p, (n, t) = self.p, x.shape
        h, q, k, v, w, part, z, m, g = saved
        dg = dy @ p["B"].T
        dg *= g > 0
        dm = dg @ p["A"].T
        dm += dy
        out = {"B": g.T @ dy, "A": m.T @ dg, "a": np.ones(n * t, dy.dtype) @ dg, "o": z.T @ dm}
        dz = np.empty((n * t, DIM + 1), dy.dtype)
        np.multiply(dm @ p["o"].T, part, out=dz[:, :-1])
        dz[:, -1] = -np.einsum("ij,ij->i", dz[:, :-1], z)
        dz = dz.reshape(n, t, -1)
        dw = dz @ _turned(v)
        dw *= w
        to = np.empty((n, t, 3 * DIM), dy.dtype)
        np.matmul(dw, k, out=to[:, :, :DIM])
        np.matmul(dw.transpose(0, 2, 1), q, out=to[:, :, DIM : 2 * DIM])
        np.matmul(w.transpose(0, 2, 1), dz[:, :, :-1], out=to[:, :, 2 * DIM :])
        to = to.reshape(n * t, -1)
        turned = h.T @ to
        out |= {"q": turned[:, :DIM] * _SCALE, "k": turned[:, DIM : 2 * DIM], "v": turned[:, 2 * DIM :]}
        dh = to @ np.concatenate([p["q"] * _SCALE, p["k"], p["v"]], 1).T
        dh += dm
        out["P"] = np.zeros_like(p["P"])
        out["P"][:t] = (np.ones(n, dy.dtype) @ dh.reshape(n, -1)).reshape(t, -1)
        return out | {"h": dh}

    def gradients(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        """Gradients of the mean negative log-probability of `target` (subwords); positions of weight 0 don't count."""
        p, (n, t) = self.p, x.shape
        size = max(1, NEAR_ROWS // t)
        blocks = [(s, self.state(x[s : s + size])) for s in range(0, n, size)]
        # Positions that count lie subword by subword, and so class by class, from here on; subwords without vectors last.
        aim = self.known[target.ravel()]
        aim[aim == 0] = len(p["D"])
        live = np.flatnonzero(weight.ravel() > 0)
        order = live[np.argsort(aim[live].astype(np.uint16), kind="stable")]
        aim, total = aim[order], max(len(order), 1)
        exact = p["E"].dtype
        y = np.ones((n * t, DIM + 1), exact)
        y[:, :-1] = np.concatenate([b[0].reshape(-1, DIM) for _, b in blocks])
        y = y[order]
        # What the subwords themselves add: sums of the states before each of them.
        first = np.flatnonzero(np.diff(aim, prepend=-1))
        sums = np.zeros((len(p["D"]) + 1, DIM + 1), exact)
        if len(first):
            sums[aim[first]] = np.add.reduceat(y, first, 0)
        C, D = np.vstack([p["C"], p["c"]]), np.concatenate([p["D"], p["d"][:, None]], 1)
        edges = np.searchsorted(aim, [e for e, _ in self.slices] + [len(D)])
        kind = np.repeat(np.arange(CLASSES), np.diff(np.append(edges, len(aim))))
        dC, dD, dy = np.zeros_like(C), -sums[:-1], np.empty((len(y), DIM), exact)
        loss, to_states = 0.0, np.ascontiguousarray(p["C"].T)
        for s in range(0, len(y), NEAR_ROWS):
            rows = slice(s, min(s + NEAR_ROWS, len(y)))
            u = y[rows] @ C
            own = u[np.arange(len(u)), kind[rows]]
            part = _exp(u, 80) @ _ONES[:CLASSES]
            loss += (np.log(part) - own).sum()
            part = 1 / part[:, None]
            dC += (y[rows] * part).T @ u
            np.multiply(u @ to_states, part, out=dy[rows])
            dy[rows] -= to_states[kind[rows]]
        dC[:, CLASSES - 1] -= sums[-1]
        # Within its class each position meets the rows of that class only.
        for c, (low, high) in enumerate(self.slices):
            rows = slice(edges[c], edges[c + 1])
            if rows.start == rows.stop:
                continue
            dC[:, c] -= sums[low:high].sum(0)
            if high - low < 2:
                dD[low:high] = 0
                continue
            u = y[rows] @ np.ascontiguousarray(D[low:high].T)
            own = u[np.arange(len(u)), aim[rows] - low]
            part = _exp(u, 80) @ np.ones(high - low, exact)
            loss += (np.log(part) - own).sum()
            part = 1 / part[:, None]
            dD[low:high] += u.T @ (y[rows] * part)
            mine = u @ D[low:high, :-1]
            mine *= part
            mine -= D[aim[rows], :-1]
            dy[rows] += mine
        dC /= total
        dD /= total
        out = {"C": dC[:-1], "c": dC[-1], "D": dD[:, :-1], "d": dD[:, -1]}
        dyf = np.zeros((n * t, DIM), exact)
        dyf[order] = dy / exact.type(total)
        parts = [self.back(x[s : s + size], dyf[s * t : (s + size) * t], saved) for s, (_, saved) in blocks]
        dh = np.concatenate([b.pop("h") for b in parts])
        out |= {k: sum(b[k] for b in parts) for k in parts[0]}
        order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
        fx = x.ravel()[order]
        first = np.flatnonzero(np.diff(fx, prepend=-1))
        out["E"] = np.zeros_like(p["E"])
        out["E"][fx[first]] = np.add.reduceat(dh[order], first, 0)
        return out, float(loss / total)

    def log_probabilities(self, ids: np.ndarray, offsets: np.ndarray, batch: int = 2048) -> np.ndarray:
        """Natural log-probability of every subword given those before it in its text (an end precedes the first)."""
        out = np.zeros(len(ids), np.float64)
        if not len(ids):
            return out
        previous = np.empty_like(ids)
        previous[1:] = ids[:-1]
        previous[offsets[:-1][np.diff(offsets) > 0]] = _END
        known, place = self.known[previous], self.known[ids]
        place[place == 0] = len(self.p["D"])
        first, scored, end = spans(offsets)
        width = end - first
        C, D = np.vstack([self.p["C"], self.p["c"]]), np.concatenate([self.p["D"], self.p["d"][:, None]], 1)
        starts = [e for e, _ in self.slices] + [len(D)]
        for later in (False, True):
            chosen = np.flatnonzero((scored > first) == later)
            chosen = chosen[np.argsort(-width[chosen], kind="stable")]
            lead = OVERLAP if later else 0
            for b in range(0, len(chosen), batch):
                found, where = [], []
                for k in range(b, min(b + batch, len(chosen)), NEAR_WINDOWS):
                    part = chosen[k : min(k + NEAR_WINDOWS, b + batch)]
                    t = int(width[part[0]])
                    at = first[part][:, None] + np.arange(t)
                    full = width[part[-1]] == t
                    y = self.states(known[at if full else np.minimum(at, len(ids) - 1)], lead)
                    pos = at[:, lead:]
                    if not full:
                        live = pos < end[part][:, None]
                        pos, y = pos[live], y[live.ravel()]
                    found.append(y)
                    where.append(pos.ravel())
                y, pos = np.concatenate(found), np.concatenate(where)
                aim = place[pos]
                order = np.argsort(aim.astype(np.uint16), kind="stable")
                y, pos, aim = y[order], pos[order], aim[order]
                edges = np.searchsorted(aim, starts)
                kind = np.repeat(np.arange(CLASSES), np.diff(np.append(edges, len(aim))))
                value, mass = np.empty(len(y), np.float32), np.empty(len(y), np.float32)
                for s in range(0, len(y), NEAR_ROWS):
                    rows = slice(s, min(s + NEAR_ROWS, len(y)))
                    u = y[rows] @ C
                    value[rows] = u[np.arange(len(u)), kind[rows]]
                    np.matmul(_exp(u, 80), _ONES[:CLASSES], out=mass[rows])
                value -= np.log(mass)
                inner, mass[:] = self.other[ids[pos]], 1
                for c, (low, high) in enumerate(self.slices):
                    if edges[c] == edges[c + 1]:
                        continue
                    inside, ones = np.ascontiguousarray(D[low:high].T), np.ones(high - low, np.float32)
                    for s in range(edges[c], edges[c + 1], NEAR_ROWS):
                        rows = slice(s, min(s + NEAR_ROWS, edges[c + 1]))
                        u = y[rows] @ inside
                        inner[rows] = u[np.arange(len(u)), aim[rows] - low]
                        np.matmul(_exp(u, 80), ones, out=mass[rows])
                inner -= np.log(mass)
                value += inner
                out[pos] = value
        return out

    def states(self, x: np.ndarray, lead: int) -> np.ndarray:
        """States from position `lead` on, one row each with a 1 behind it; earlier positions are past only. Projections
        come from tables."""
        p, (n, t) = self.p, x.shape
        if not hasattr(self, "tables"):
            joined = lambda e, last: np.concatenate([e @ p["k"], e @ p["v"], np.full((len(e), 1), last)], 1).astype(np.float32)
            own = lambda e: np.concatenate([e @ p["q"] * _SCALE, e], 1)
            self.tables = joined(p["E"], 1), joined(p["P"], 0), own(p["E"]), own(p["P"])
        past, past_at, mine, mine_at = self.tables
        kv = past.take(x, axis=0)
        kv += past_at[:t]
        qe = mine.take(x[:, lead:], axis=0)
        qe += mine_at[lead:t]
        w = qe[:, :, :DIM] @ _turned(kv[:, :, :DIM])
        _exp(w, 60)
        w *= _PAST[lead:t, :t]
        z = (w @ kv[:, :, DIM:]).reshape(-1, DIM + 1)
        m = (z[:, :-1] / z[:, -1:]) @ p["o"]
        m += qe[:, :, DIM:].reshape(-1, DIM)
        g = m @ p["A"]
        g += p["a"]
        np.maximum(g, 0, out=g)
        out = np.ones((len(m), DIM + 1), np.float32)
        np.add(m, g @ p["B"], out=out[:, :-1])
        return out


class Trainer:
    """Steps of the weights of a model over texts, block by block."""

    def __init__(self, model: Model, rate: float, seed: int):
        self.model, self.rate, self.steps, self.tokens = model, rate, 0, 0
        self.rng = np.random.default_rng(seed)
        self.m, self.s = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))

    def learn(self, flat: np.ndarray, offsets: np.ndarray, batch: int = STEP) -> None:
        """One pass over the texts' subwords in windows without overlap, in a drawn order."""
        model, p = self.model, self.model.p
        previous = np.append(np.int32(_END), flat[:-1])
        previous[offsets[:-1]] = _END
        many = -(-np.diff(offsets) // CONTEXT)
        row = np.repeat(np.arange(len(many)), many)
        first = offsets[:-1][row] + long_range(many) * CONTEXT
        end = np.minimum(first + CONTEXT, offsets[1:][row])
        order = self.rng.permutation(len(first))
        for part in np.array_split(order, max(1, len(order) // batch)):
            at = first[part][:, None] + np.arange(CONTEXT)
            live = (at < end[part][:, None]).astype(np.float32)
            at = np.minimum(at, len(flat) - 1)
            g, _ = model.gradients(model.known[previous[at]], flat[at], live)
            self.steps += 1
            for k, x in g.items():
                m, s, by = self.m[k], self.s[k], x * x
                by -= s
                by *= 0.005
                s += by
                np.subtract(x, m, out=by)
                by *= 0.1
                m += by
                np.divide(s, 1 - 0.995**self.steps, out=by)
                np.sqrt(by, out=by)
                by += 1e-8
                np.divide(m, by, out=by)
                by *= self.rate / (1 - 0.9**self.steps)
                p[k] -= by
        self.tokens += len(flat)


def rate(k: int) -> float:
    """Step size of the k-th round."""
    return 0.01 * 0.45**k


def encoded(texts: pa.Array, spelling: Spelling) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of all texts, each with its end, and the offsets of the texts in them."""
    words = Words(texts)
    return sequences(words, *spelling.ids(words))


def train(texts: pa.Array, folder: str = VOCABULARIES, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Fit on the texts in this process, as a single task of `fit` would."""
    flat, offsets = encoded(texts, Spelling(folder))
    counts = np.bincount(flat, minlength=_VOCAB)
    top, known = ranked(counts)
    model = Model(counts, neighbours(flat, known, len(top)), seed)
    for k in range(rounds if len(texts) else 0):
        Trainer(model, rate(k), seed + k).learn(flat, offsets)
    return model


def _dealt():
    """What deals a row to a round: a hash of id and text."""
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(DEALT)).alias("dealt")


def _packed(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Subwords of texts as 16-bit numbers, one binary value a text."""
    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets * 2), pa.py_buffer(flat.astype(np.uint16))])
    return ids.cast(pa.binary())


def _encode(folder: str):
    """Each text's subwords, with what deals the text to a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling(folder)
        for batch in text_blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("dealt"), _packed(*encoded(batch.column("text"), spelling))], ["dealt", "ids"])

    return run


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of all texts of a column of `_packed`, and the offsets of the texts in them."""
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint16, (offsets[-1] - offsets[0]) // 2, offsets[0]).astype(np.int32), (offsets - offsets[0]) // 2


def _id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Subwords and offsets of the texts of each batch."""
    for batch in batches:
        if batch.num_rows:
            yield _unpacked(batch.column("ids"))
    release()


def _subword_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_VOCAB, np.int64)
    for flat, _ in _id_blocks(batches):
        total += np.bincount(flat, minlength=_VOCAB)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["subword", "n"])


def _neighbours(known: np.ndarray, n_top: int):
    """A task's neighbours of subwords, in those slices that hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for flat, _ in _id_blocks(batches):
            found = neighbours(flat, known, n_top)
            total = found if total is None else np.add(total, found, out=total)
        if total is not None:
            parts = {k: total[s : s + SLICE] for k, s in enumerate(range(0, len(total), SLICE))}
            parts = {k: x.tobytes() for k, x in parts.items() if x.any()}
            yield pa.RecordBatch.from_arrays([pa.array(parts.keys(), pa.int64()), pa.array(parts.values(), pa.binary())], ["slice", "n"])

    return run


def _added(slices: pa.Table) -> pa.Table:
    total = 0
    for blob in slices["n"].to_pylist():
        total = total + np.frombuffer(blob, np.int64)
    return pa.table({"slice": slices["slice"][:1], "n": pa.array([total.tobytes()], pa.binary())})


def _form(counts: np.ndarray, n_top: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = np.zeros((n_top + 1) * 2 * min(n_top, WIDTH), np.int64)
        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("n").to_pylist()):
                around[k * SLICE : (k + 1) * SLICE] = np.frombuffer(blob, np.int64)
        model = pickle.dumps(Model(counts, around, seed))
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    return run


def _round(sent, k: int, batch: int):
    """A task's weights after a pass over its texts, times its tokens, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = None
        for flat, offsets in _id_blocks(batches):
            trainer = trainer or Trainer(pickle.loads(sent.value), rate(k), 100 + k)
            trainer.learn(flat, offsets, batch)
        if trainer is not None:
            v = trainer.model.vector().astype(np.float64) * trainer.tokens
            parts = [v[s : s + SLICE].tobytes() for s in range(0, len(v), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([trainer.tokens] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["slice", "tokens", "weights"])

    return run


def _averaged(slices: pa.Table) -> pa.Table:
    total, weights = 0, 0.0
    for tokens, blob in zip(slices["tokens"].to_pylist(), slices["weights"].to_pylist()):
        total, weights = total + tokens, weights + np.frombuffer(blob)
    return pa.table({"slice": slices["slice"][:1], "weights": pa.array([(weights / total).astype(np.float32).tobytes()], pa.binary())})


def of_round(k: int, rounds: int, count: int, least: int):
    """Which of `count` documents round k goes over, by their column `dealt`, and their share: a part of its own of a
    large corpus, wider parts where that is under `least` documents. All rounds together go over every document."""
    share = max(1 / rounds, min(1.0, least / max(1, count)))
    return F.pmod(F.col("dealt") - k * DEALT // rounds, F.lit(DEALT)) < math.ceil(share * DEALT), share


def fit(docs: DataFrame, folder: str = VOCABULARIES, least: int = LEAST_DOCUMENTS, task_documents: int = TASK_DOCUMENTS, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Train on all documents (whole texts of any length); each round goes over `least` at least, if there are as many.

    Documents are dealt to rounds by a hash of id and text; null texts are ends alone. In each round every task starts
    from the same weights and passes once over its documents; the driver holds one model, whatever the number of tasks.
    Without documents the model spreads its mass evenly.
    """
    arrow_limits(docs.sparkSession)
    return _fit(written(docs.select(_dealt(), "text").mapInArrow(_encode(folder), "dealt long, ids binary"), "learn"), least, task_documents, rounds, seed)


def _fit(texts: DataFrame, least: int = LEAST_DOCUMENTS, task_documents: int = TASK_DOCUMENTS, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """`fit` on a written table of encoded texts (dealt, ids)."""
    spark = texts.sparkSession
    count = texts.count()
    counts = np.zeros(_VOCAB, np.int64)
    found = texts.select("ids").mapInArrow(_subword_counts, "subword long, n long").groupBy("subword").agg(F.sum("n").alias("n")).toArrow()
    counts[found["subword"].to_numpy()] = found["n"].to_numpy()
    top, known = ranked(counts)
    around = texts.select("ids").mapInArrow(_neighbours(known, len(top)), "slice long, n binary").groupBy("slice").applyInArrow(_added, "slice long, n binary")
    formed = around.coalesce(1).mapInArrow(_form(counts, len(top), seed), "model binary").collect()
    model = pickle.loads(formed[0]["model"]) if formed else Model(counts, neighbours(np.zeros(0, np.int32), known, len(top)), seed)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(pickle.dumps(model))
        chosen, share = of_round(k, rounds, count, least)
        tasks = max(1, math.ceil(share * count / task_documents))
        part = texts.filter(chosen).select("ids").repartition(tasks)
        ends = part.mapInArrow(_round(sent, k, STEP if tasks == 1 else WIDE_STEP), "slice long, tokens long, weights binary")
        rows = ends.groupBy("slice").applyInArrow(_averaged, "slice long, weights binary").toArrow().sort_by("slice")
        if rows.num_rows:
            model.take(np.concatenate([np.frombuffer(x, np.float32) for x in rows["weights"].to_pylist()]))
        sent.destroy()
    release()
    return model


_READ = "doc_id long, learns boolean, dealt long, ids binary, n_tokens long, head_known long, head_base double, rare array<long>"


def _read(sent, folder: str, total: float, distinct: int):
    """Each text's subwords and its figures by word counts, words outside the head aside; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, counts = pickle.loads(sent.value)
        spelling = Spelling(folder)
        base = np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1)))
        for batch in text_blocks(batches, "text"):
            words = Words(batch.column("text"))
            rows = batch.num_rows
            ids = _packed(*sequences(words, *spelling.ids(words)))
            n = np.diff(words.offsets)
            token = np.concatenate([words.hashes, np.full(rows, END_HASH, np.uint64)])
            row = np.concatenate([np.repeat(np.arange(rows), n), np.arange(rows)])
            at = np.minimum(np.searchsorted(head, token), max(len(head) - 1, 0))
            hit = head[at] == token if len(head) else np.zeros(len(token), bool)
            order = np.argsort(row[~hit], kind="stable")
            rare, cut = token[~hit][order].view(np.int64), np.searchsorted(row[~hit][order], np.arange(rows + 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "learns", "dealt")), ids, pa.array(n + 1), pa.array(np.bincount(row[hit], minlength=rows).astype(np.int64)), pa.array(np.bincount(row[hit], base[at[hit]], rows).astype(np.float64)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(rare))],
                ["doc_id", "learns", "dealt", "ids", "n_tokens", "head_known", "head_base", "rare"])

    return run


def _score(sent, limit: int = BLOCK // 2):
    """Scores of encoded texts, about `limit` subwords at once; a longer text stands alone. The other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for batch in batches:
            flat, offsets = _unpacked(batch.column("ids"))
            first, scores = 0, [np.zeros(0)]
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
                places = offsets[first : last + 1] - offsets[first]
                sums = np.append(0.0, np.cumsum(model.log_probabilities(flat[offsets[first] : offsets[last]], places)))
                scores.append((sums[places[1:]] - sums[places[:-1]]) / np.log(10))
                first = last
            kept = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.concatenate(scores))], [*kept, "score"])
        release()

    return run


def log_probabilities(docs: DataFrame, training: DataFrame | Column, folder: str = VOCABULARIES, head_words: int = HEAD_WORDS, **settings) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs, learning from `training`: a
    table of its own, or a condition on doc_id and text that marks rows of docs, which are encoded once then.

    base_score is the text's log10 probability by word counts with 0.1 added, score that of the model. Null and blank
    texts are one end; texts of any length are scored whole. Repeated rows are scored alike, also under one doc_id, and
    null ids are kept; other columns are not read. An empty training table has no counts: base_score is then that of
    0.1 / (0.1 * 1) for each token. An empty docs table gives no rows. `settings` go to `fit`.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    marks = isinstance(training, Column)
    counts = written(word_counts(docs.filter(training) if marks else training), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = counts.orderBy(F.desc("n"), "word").limit(head_words).toArrow()
    word, n = head["word"].to_numpy().astype(np.int64).view(np.uint64), head["n"].to_numpy().astype(np.float64)
    order = np.argsort(word)
    sent = spark.sparkContext.broadcast(pickle.dumps((word[order], n[order])))
    learns = (training if marks else F.lit(False)).alias("learns")
    rows = docs.select("doc_id", learns, _dealt(), "text").mapInArrow(_read(sent, folder, float(total), distinct), _READ)
    # The key stands for a row from here on, since the table is written with it.
    rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "read")
    sent.destroy()
    model = _fit(rows.filter("learns").select("dealt", "ids"), **settings) if marks else fit(training, folder, **settings)
    sent = spark.sparkContext.broadcast(pickle.dumps(model))
    plain = rows.select("key", "doc_id", "n_tokens", "head_known", "head_base", F.size("rare").cast("long").alias("n_rare"), "ids")
    scored = written(plain.mapInArrow(_score(sent), "key long, doc_id long, n_tokens long, head_known long, head_base double, n_rare long, score double"), "scored")
    sent.destroy()
    # Words outside the head: their counts, if the corpus has them, by a join on the hash.
    rare = rows.select("key", F.explode("rare").alias("word")).join(counts, "word")
    known = rare.groupBy("key").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("n") + 0.1) - F.log10(F.lit(0.1))).alias("gain"))
    unseen = float(np.log10(0.1 / (float(total) + 0.1 * (distinct + 1))))
    base = F.col("head_base") + F.col("n_rare") * F.lit(unseen) + F.coalesce("gain", F.lit(0.0))
    return scored.join(known, "key", "left").select("doc_id", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores of every document, learning from rows with crc32(doc_id) mod 10 other than 0.

    Rows with a null id are learnt from and scored, null and empty texts are one end, repeated rows are scored alike;
    columns other than doc_id and text are not read. An empty table gives no rows.
    """
    held = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    out = log_probabilities(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
