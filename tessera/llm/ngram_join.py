"""Exact Jaccard self-join of documents on word shingles by grouped prefixes.

Shingle sets are ordered rare first; two sets that reach the threshold share a token of their prefixes (the
first n - ceil(t*n) + 1 tokens). Sets with equal prefixes and sizes form one group, so the inverted index holds
a row for each group and token. Token lists of groups give group pairs under size and position filters; pairs are
expanded to members; those that pass a bound from outlines (a bit for each hash class of tokens) are verified on
whole sets. Lists longer than `LONG` (clusters of near-copies) are not paired: see _resolve_long.

Texts that have nothing else in common meet by chance in a number that grows with the square of the table. The
outlines keep those pairs from whole sets, which only pairs that may be links and members of long lists read.

Hashes of 64 bits stand for shingles. Nothing is capped: the bound on frequent tokens held in memory only decides
how well rare tokens come first, never which links are found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import Words, arrow_limits, long_range, mix, release, text_blocks, written

WORDS = 5
#: A link is 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A token of so many documents counts as frequent and comes late in the order.
FREQUENT = 16
#: Frequent tokens kept for the order, 16 bytes each on every worker; the most frequent are kept.
KEPT = 500_000
#: Tokens of more documents than this bypass the packed index: their lists may hold any share of the rows.
HOT = 4096
#: Longer lists of groups go through pivots instead of pairs.
LONG = 24
#: Comparisons of prefixes within one list of difference tokens; longer lists get a pivot of their own.
WORK = 50_000
#: After a round, lists of no more members are paired: outlines decide which pairs read whole sets.
FEW = 128
#: Rounds of pivots before what is left is joined by prefixes within its lists.
ROUNDS = 8
#: Bytes of text for each range of the packed exchanges.
RANGE_BYTES = 20_000_000

_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, k, 2**64)) for k in range(64)]
_SHIFT = np.uint64(16)


def shingles(words: Words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): for each row its distinct shingles in ascending order; fewer words make one shingle."""
    h, offsets = words.hashes, words.offsets
    counts = np.diff(offsets)
    runs = np.where(counts >= size, counts - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), runs)
    at = long_range(runs) + np.repeat(offsets[:-1], runs)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out += h[at + k] * _STEP[k]
    out = mix(out + np.uint64(size))
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.array([int(mix(np.array([sum(int(h[offsets[r] + k]) * int(_STEP[k]) for k in range(counts[r])) + int(counts[r]) & (2**64 - 1)], np.uint64))[0]) for r in short], np.uint64)
        out, row = np.concatenate([out, extra]), np.concatenate([row, short])
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(len(counts) + 1))


def _need(n):
    """Least intersection that a set of n tokens has with any partner."""
    return -(-PERCENT * n // 100)


def _linked(shared, a, b):
    return 100 * shared >= PERCENT * (a + b - shared)


def pack(values: np.ndarray) -> bytes:
    """Ascending integers as compressed byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _ranges(docs: DataFrame) -> int:
    return max(16, math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / RANGE_BYTES))


def _range_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """Equal shares of the 48-bit tokens."""
    return ((tokens >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _count_tokens(ranges: int, size: int):
    """Each task's counts of tokens (the leading 48 bits), packed by token range."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held) >> _SHIFT, return_counts=True)
        at = np.searchsorted(_range_of(tokens, ranges), np.arange(ranges + 1))
        keys, blobs, many = [], [], []
        for r in np.flatnonzero(np.diff(at)):
            part = slice(at[r], at[r + 1])
            keys.append(r)
            blobs.append(pack(tokens[part]))
            many.append(zstandard.compress(np.minimum(counts[part], 2**31 - 1).astype("<i4").tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary()), pa.array(many, pa.binary())], ["part", "tokens", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in text_blocks(batches, "text"):
            found, _ = shingles(Words(batch.column("text")), size)
            if len(found):
                held.append(found)
                n += len(found)
            if n > 3_000_000:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)
            held.clear()
        release()

    return run


def _frequent(table: pa.Table) -> pa.Table:
    tokens = np.concatenate([unpack(x) for x in table["tokens"].to_pylist()])
    counts = np.concatenate([np.frombuffer(zstandard.decompress(x), "<i4") for x in table["counts"].to_pylist()]).astype(np.int64)
    order = np.argsort(tokens, kind="stable")
    tokens, counts = tokens[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    total = np.add.reduceat(counts, first)
    keep = total >= FREQUENT
    release()
    return pa.table({"token": tokens[first][keep].astype(np.int64), "n": total[keep]})


def _counts_of(frequent, cut: np.ndarray) -> np.ndarray:
    """Document counts of frequent tokens, 0 for others."""
    known, counts = (np.frombuffer(x, np.int64) for x in frequent.value)
    weight = np.zeros(len(cut), np.int64)
    if len(known) and len(cut):
        known = known.view(np.uint64)
        where = np.minimum(np.searchsorted(known, cut), len(known) - 1)
        hit = known[where] == cut
        weight[hit] = counts[where[hit]]
    return weight


def _sets(frequent, percent: int, size: int):
    """Each document's set size, 128-bit set digest and prefix in the order (frequency if frequent, hash).

    The prefix is written as six bytes a token, its digest and the set's outline beside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text"):
            tokens, at = shingles(Words(batch.column("text")), size)
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            padded = np.append(mix(tokens), np.uint64(0)), np.append(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), np.uint64(0))
            digest = [np.where(n > 0, np.add.reduceat(x, np.minimum(at[:-1], len(tokens))), np.uint64(0)).astype(np.uint64) for x in padded]
            order = np.lexsort((tokens, _counts_of(frequent, tokens >> _SHIFT), row))
            six = np.ascontiguousarray((tokens[order] >> _SHIFT).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
            prefix = np.where(n > 0, n + percent * n // -100 + 1, 0)
            blobs = [six[s : s + p].tobytes() for s, p in zip(at[:-1], prefix)]
            key = [hashlib.blake2b(x, digest_size=16).digest() for x in blobs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in digest), pa.array(key, pa.binary()), pa.array(blobs, pa.binary()), pa.array(outlines(tokens, at), pa.binary())],
                ["doc_id", "n", "d1", "d2", "key", "prefix", "outline"],
            )

    return run


def outlines(tokens: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A bitmap for each set: of as many bits as the power of two from its size up, 64 at least, each set if a token has it as its lowest bits."""
    n = np.diff(at)
    bits = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1)))).astype(np.int64)
    ends = np.cumsum(bits)
    flags = np.zeros(int(bits.sum()), np.uint8)
    flags[np.repeat(ends - bits, n) + (tokens & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)] = 1
    packed = np.packbits(flags, bitorder="little").tobytes()
    return [packed[s:e] for s, e in zip((ends - bits) // 8, ends // 8)]


def may_link(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """False where the outlines rule out a link: a bit that only one set has stands for a token that only it has."""
    widths = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    out = np.zeros(len(a), bool)
    for pair in np.unique(widths, axis=0):
        where = np.flatnonzero((widths == pair).all(1))
        # A longer bitmap folds to the shorter one's lowest bits.
        x, y = (np.bitwise_or.reduce(np.frombuffer(b"".join(side[k] for k in where), np.uint8).reshape(len(where), -1, pair.min()), 1) for side in (a, b))
        alone = [np.bitwise_count(u & ~v).sum(1, dtype=np.int64) for u, v in ((x, y), (y, x))]
        most = np.minimum(na[where] - alone[0], nb[where] - alone[1])
        out[where] = _linked(most, na[where], nb[where])
    return out


def _possible_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("oa").to_pylist(), batch.column("ob").to_pylist()
        keep = may_link(a, b, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in "ab"], ["a", "b"])


def _worth_verifying(pairs: DataFrame, every: DataFrame) -> DataFrame:
    """The pairs that the outlines of their sets allow."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    known = every.filter("n > 0").select("doc_id", "n", "outline").distinct().join(ids, "doc_id", "left_semi")
    left, right = (known.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("outline").alias(f"o{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").mapInArrow(_possible_pairs, "a long, b long").distinct()


def _tokens_of(blobs: list[bytes]) -> np.ndarray:
    six = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel().astype(np.uint64)


def _index(ranges: int, hot: bool, frequent):
    """Postings (token, group, size, position): hot tokens as rows, the others packed by token range."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        token, group, n, pos = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(token, kind="stable")
        token, group, n, pos = (x[order] for x in (token, group, n, pos))
        at = np.searchsorted(_range_of(token, ranges), np.arange(ranges + 1))
        full = np.flatnonzero(np.diff(at))
        blob = lambda x, kind: pa.array([zstandard.compress(x[at[r] : at[r + 1]].astype(kind).tobytes(), 1) for r in full], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([pack(token[at[r] : at[r + 1]]) for r in full], pa.binary()), blob(group, "<i8"), blob(n, "<i4"), blob(pos, "<i4")], ["part", "token", "gid", "n", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            blobs = batch.column("prefix").to_pylist()
            token = _tokens_of(blobs)
            size = np.array([len(x) // 6 for x in blobs], np.int64)
            mine = (_counts_of(frequent, token) > HOT) == hot
            group, token = np.repeat(batch.column("gid").to_numpy(), size)[mine], token[mine]
            if hot:
                row = np.repeat(batch.column("row").to_numpy(), size)[mine]
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(group), pa.array(row)], ["token", "gid", "row"])
            elif len(token):
                held.append((token, group, np.repeat(batch.column("n").to_numpy(), size)[mine], long_range(size)[mine]))
                many += len(token)
                if many > 2_000_000:
                    yield flush(held)
                    held, many = [], 0
        if held:
            yield flush(held)

    return run


def _possible(na, nb, pa_, pb):
    """Size filter, and the position filter at the first common token: what can still be shared suffices."""
    most = 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
    return (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)) & _linked(most, na, nb)


def _lists(table: pa.Table, longest: int) -> pa.Table:
    """Group pairs of the lists of one token range; longer lists come out as rows (b null) for the pivots."""
    token = np.concatenate([unpack(x) for x in table["token"].to_pylist()])
    part = lambda c, kind: np.concatenate([np.frombuffer(zstandard.decompress(x), kind) for x in table[c].to_pylist()]).astype(np.int64)
    group, n, pos = part("gid", "<i8"), part("n", "<i4"), part("pos", "<i4")
    order = np.lexsort((group, n, token))
    token, group, n, pos = token[order], group[order], n[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    many = np.diff(np.append(first, len(token)))
    a, b = [], []
    for s in np.unique(many[(many > 1) & (many <= longest)]):
        at = first[many == s][:, None]
        i, j = np.triu_indices(s, 1)
        i, j = (at + i).ravel(), (at + j).ravel()
        keep = _possible(n[i], n[j], pos[i], pos[j])
        a.append(np.minimum(group[i], group[j])[keep])
        b.append(np.maximum(group[i], group[j])[keep])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.zeros((0, 2), np.int64)
    long_ = np.repeat(many > longest, many)
    k, m = len(pairs), int(long_.sum())
    null = lambda x, before: pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(x)] if before else [pa.array(x), pa.nulls(m, pa.int64())])
    return pa.table({"a": pa.array(np.concatenate([pairs[:, 0], group[long_]])), "b": null(pairs[:, 1], False), "token": null(token[long_].view(np.int64), True), "n": null(n[long_], True), "pos": null(pos[long_], True)})


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            tokens, at = shingles(Words(block.column("text")), size)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([tokens[s:e].tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary())], ["id", "tokens"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows, np.int64)
        a, b = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
        na, nb = (np.array([len(y) // 8 for y in x], np.int64) for x in (a, b))
        for k in range(len(a)):
            both = np.concatenate([np.frombuffer(a[k], np.uint64), np.frombuffer(b[k], np.uint64)])
            both.sort()
            out[k] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(_linked(out, na, nb))], ["a", "b", "linked"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs, and whether their exact Jaccard similarity makes a link."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_shared, "a long, b long, linked boolean")


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symmetric difference of each member with its pivot's set, and the sizes of both."""
    for batch in batches:
        mine, theirs = batch.column("tokens").to_pylist(), batch.column("of_pivot").to_pylist()
        out, rest = [], []
        for a, b in zip(mine, theirs):
            both = np.concatenate([np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)])
            both.sort()
            twice = both[1:] == both[:-1]
            alone = np.ones(len(both), bool)
            alone[1:] &= ~twice
            alone[:-1] &= ~twice
            out.append(both[alone])
            rest.append((len(a) // 8, len(b) // 8))
        n, p = (np.array(x, np.int64) for x in zip(*rest)) if rest else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("id"), pa.array(n), pa.array(p), pa.array([len(x) for x in out], pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["pivot", "id", "n", "np", "size", "tokens"])


_DIFFERENCES = "pivot long, id long, n long, np long, size long, tokens array<long>"


def _as_rows(*keep: str):
    """The columns `keep`, the set's size and a token, for every token of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("tokens").to_pylist()
            n = np.array([len(x) // 8 for x in blobs], np.int64)
            columns = [np.repeat(batch.column(c).to_numpy(), n) for c in keep] + [np.repeat(n, n), np.frombuffer(b"".join(blobs), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [*keep, "n", "token"])

    return run


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("pivot"), pa.array([np.sort(np.array(x, np.int64).view(np.uint64)).tobytes() for x in batch.column("tokens").to_pylist()], pa.binary())], ["pivot", "of_pivot"])


def _within_lists(long_: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the same list, by a prefix join of its own.

    Tokens are ordered by how many members of the list hold them, so what brought the members together comes last
    and members that share little else do not meet.
    """
    tokens = long_.select("list", "id").join(sets, "id").mapInArrow(_as_rows("list", "id"), "list long, id long, n long, token long")
    tokens = written(tokens, "list-tokens")
    common = tokens.groupBy("list", "token").agg(F.count("*").alias("df")).filter("df > 1")
    order = Window.partitionBy("list", "id").orderBy("df", "token")
    index = tokens.join(common, ["list", "token"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    index = index.withColumn("pos", F.row_number().over(order) - 1)
    index = written(index.filter(f"df > 1 AND pos <= n - ({PERCENT} * n + 99) div 100").drop("df"), "list-index")
    left, right = (index.select("list", "token", *(F.col(c).alias(x + c) for c in ("id", "n", "pos"))) for x in "ab")
    most = F.least(F.col("an") - F.col("apos"), F.col("bn") - F.col("bpos"))
    fits = (F.col("aid") < F.col("bid")) & (100 * most >= PERCENT * (F.col("an") + F.col("bn") - most))
    return left.join(right, ["list", "token"]).filter(fits).select(F.col("aid").alias("a"), F.col("bid").alias("b")).distinct()


def _set_outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = batch.column("tokens").to_pylist()
        n = np.array([len(x) // 8 for x in blobs], np.int64)
        made = outlines(np.frombuffer(b"".join(blobs), np.uint64), np.append(0, np.cumsum(n)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(made, pa.binary())], ["doc_id", "n", "outline"])


def _paired(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among all pairs of each list."""
    left, right = (lists.select("list", F.col("id").alias(x)) for x in "ab")
    pairs = written(left.join(right, "list").filter("a < b").select("a", "b").distinct(), "few")
    pairs = written(_worth_verifying(pairs, sets.mapInArrow(_set_outlines, "doc_id long, n long, outline binary")), "possible")
    return written(_verify(pairs, sets).filter("linked").select("a", "b"), "links")


def _open_lists(long_: DataFrame, links: list[DataFrame]) -> DataFrame:
    """The lists whose members the links do not connect yet: in the others a further link changes no component."""
    labels = components(_union(links))
    parts = long_.join(labels, "id", "left").groupBy("list").agg(*(f(F.coalesce("component", "id")).alias(x) for x, f in (("low", F.min), ("high", F.max))))
    return long_.join(parts.filter("low != high").select("list"), "list", "left_semi")


def _resolve_long(long_: DataFrame, sets: DataFrame, rounds: int, work: int, paired: int) -> list[DataFrame]:
    """Links that connect all that is linked within long lists (list, id), without pairing their members.

    With D(s) the symmetric difference of s and some fixed set C, and k = (100 - P) / (100 + P), s and x are linked
    exactly if |D(s) ^ D(x)| <= k (ns + nx). With u = |D| - k n this needs (u(s) + u(x)) / 2 common tokens of D(s) and
    D(x). Pairs with u(s) + u(x) <= 0 are linked whatever they share, and each of both is so linked with the member
    of least u: a star of links stands for all of those. Every other link has a stray (u + least u > 0) at one end and
    shares tokens of the differences, so rare-first prefixes of the differences must meet.

    C is the consensus of a list: the tokens in most of its members near a pivot, a member drawn by hash. Lists with
    one pivot count as one. Members far from the pivot go on with another, together with those between (outer), which
    may be linked with them; so do difference tokens whose own lists are long, each unless its members are connected by
    now. Of these, lists of at most `paired` members are paired. After `rounds` what is left goes to _within_lists. A round
    reads the sets of its own members only.
    """
    P, found = PERCENT, []
    unit = (100 - P) / (100 + P)
    for k in range(rounds):
        sets = written(sets.join(long_.select("id").distinct(), "id", "left_semi"), "of-lists")
        draw = [F.xxhash64("id", F.lit(k)), F.col("id")]
        chosen = long_.groupBy("list").agg(F.min_by("id", F.struct(*([~F.col("far")] if "far" in long_.columns else []), *draw)).alias("pivot"))
        spokes = long_.select("list", "id").join(chosen, "list")
        of_pivot = sets.select(F.col("id").alias("pivot"), F.col("tokens").alias("of_pivot"))
        members = spokes.select("pivot", "id").distinct().join(sets, "id")
        rows = members.join(of_pivot, "pivot").select("pivot", "id", "tokens", "of_pivot").mapInArrow(_differences, _DIFFERENCES).drop("tokens")
        reach = unit * (F.col("n") + F.col("np"))
        rows = written(rows.withColumn("far", F.col("size") > 3.6 * reach).withColumn("outer", F.col("size") > 2.0 * reach), "distances")
        near = written(members.join(rows.filter("NOT far").select("pivot", "id"), ["pivot", "id"]), "near")
        votes = near.mapInArrow(_as_rows("pivot"), "pivot long, n long, token long").groupBy("pivot", "token").agg(F.count("*").alias("votes"))
        sizes = near.groupBy("pivot").agg(F.count("*").alias("many"))
        consensus = votes.join(sizes, "pivot").filter("2 * votes > many").groupBy("pivot").agg(F.collect_list("token").alias("tokens"))
        consensus = sizes.join(consensus, "pivot", "left").select("pivot", F.coalesce("tokens", F.array().cast("array<long>")).alias("tokens"))
        consensus = written(consensus.mapInArrow(_as_bytes, "pivot long, of_pivot binary"), "consensus")
        diff = near.join(consensus, "pivot").select("pivot", "id", "tokens", "of_pivot").mapInArrow(_differences, _DIFFERENCES)
        # 180 u: whole numbers.
        diff = written(diff.withColumn("u", (100 + P) * F.col("size") - (100 - P) * F.col("n")).drop("np"), "differences")
        least = diff.groupBy("pivot").agg(F.min(F.struct("u", "id")).alias("x")).select("pivot", F.col("x.u").alias("low"), F.col("x.id").alias("hub"))
        diff = diff.join(least, "pivot").withColumn("stray", F.col("u") + F.col("low") > 0)
        found.append(written(diff.filter("NOT stray AND id != hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")), "hubs"))
        strays = diff.filter("stray").select("pivot").distinct()
        whole = 2 * (100 + P)
        as_stray = F.greatest(F.lit(1), F.ceil((F.col("u") + F.col("low")) / whole - 1e-9))
        as_partner = F.greatest(F.lit(1), F.floor((F.col("u") - F.col("low")) / whole + 1e-9).cast("long") + 1)
        index = diff.join(strays, "pivot", "left_semi").withColumn("long", F.when(F.col("stray"), as_stray).otherwise(as_partner)).withColumn("short", F.greatest("long", as_partner))
        index = index.select("pivot", "id", "n", "u", "size", "stray", "long", "short", F.explode("tokens").alias("token"))
        common = index.groupBy("pivot", "token").agg(F.count("*").alias("df")).filter("df > 1")
        order = Window.partitionBy("pivot", "id").orderBy("df", "token")
        index = index.join(common, ["pivot", "token"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
        index = index.withColumn("pos", F.row_number().over(order) - 1).filter("df > 1 AND pos <= size - long")
        index = index.withColumn("short", F.col("pos") <= F.col("size") - F.col("short"))
        index = written(index.drop("long", "df"), "index")
        load = index.groupBy("pivot", "token").agg(F.count_if("stray").alias("s"), F.count_if(~F.col("stray")).alias("x"), F.count_if(F.col("stray") & F.col("short")).alias("h"))
        load = written(load.withColumn("work", F.col("s") * F.col("x") + F.col("h") * F.col("h")).filter("s > 0 AND (x > 0 OR h > 1)"), "load")
        few = index.join(load.filter(F.col("work") <= work).select("pivot", "token"), ["pivot", "token"], "left_semi")
        left = few.filter("stray").select("pivot", "token", F.col("id").alias("s"), F.col("n").alias("sn"), F.col("u").alias("su"), F.col("size").alias("ss"), F.col("pos").alias("sp"), F.col("short").alias("sh"))
        right = few.select("pivot", "token", "id", "n", "u", "size", "pos", "stray", "short")
        most = F.least(F.col("ss") - F.col("sp"), F.col("size") - F.col("pos"))
        fits = (F.col("su") + F.col("u") <= whole * most) & (100 * F.least("n", "sn") >= P * F.greatest("n", "sn"))
        meet = (~F.col("stray") | (F.col("short") & F.col("sh") & (F.col("id") > F.col("s")))) & fits
        pairs = left.join(right, ["pivot", "token"]).filter(meet).select(F.least("id", "s").alias("a"), F.greatest("id", "s").alias("b")).distinct()
        found.append(written(_verify(pairs, sets).filter("linked").select("a", "b"), "strays"))
        crowded = index.join(load.filter(F.col("work") > work).select("pivot", "token"), ["pivot", "token"], "left_semi")
        crowded = crowded.select(F.xxhash64("pivot", "token", F.lit(k)).alias("list"), "id", F.lit(False).alias("far"))
        away = spokes.join(rows.filter("far OR outer").select("pivot", "id", "far"), ["pivot", "id"]).select("list", "id", "far")
        away = away.join(away.filter("far").select("list").distinct(), "list", "left_semi").withColumn("list", F.xxhash64("list", F.lit(k)))
        long_ = written(away.union(crowded).distinct(), "long")
        if not long_.isEmpty():
            open_ = _open_lists(long_, found)
            long_ = written(open_.join(open_.groupBy("list").agg(F.count("*").alias("many")), "list"), "open")
            short, long_ = long_.filter(F.col("many") <= paired).drop("many"), long_.filter(F.col("many") > paired).drop("many")
            if not short.isEmpty():
                found.append(_paired(short, sets))
        if long_.isEmpty():
            return found
    sets = written(sets.join(long_.select("id").distinct(), "id", "left_semi"), "of-lists")
    found.append(written(_verify(_within_lists(long_, sets), sets).filter("linked").select("a", "b"), "strays"))
    return found


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, rounds: int = ROUNDS, longest: int = LONG, work: int = WORK, few: int = FEW) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    component_id is the smallest id reachable through links, the row's own if it has none. Null and blank texts have
    no shingles and no links. Repeated ids are rows of their own with the same answer; a null id is never linked
    and gets a null component. Columns beside the two named ones are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = _ranges(docs)
    counts = docs.mapInArrow(_count_tokens(ranges, size), "part long, tokens binary, counts binary")
    frequent = counts.groupBy("part").applyInArrow(_frequent, "token long, n long")
    kept = frequent.orderBy(F.desc("n"), "token").limit(KEPT).toArrow()
    order = np.argsort(kept["token"].to_numpy())
    sent = spark.sparkContext.broadcast(tuple(kept[c].to_numpy().astype(np.int64)[order].tobytes() for c in ("token", "n")))
    every = written(docs.mapInArrow(_sets(sent, PERCENT, size), "doc_id long, n long, d1 long, d2 long, key binary, prefix binary, outline binary"), "sets")

    some = every.filter("n > 0 AND doc_id IS NOT NULL")
    texts = written(some.groupBy("d1", "d2", "n", "key").agg(F.min("doc_id").alias("rep")), "texts")
    groups = texts.groupBy("key", "n").agg(F.min(F.struct("rep", "d1", "d2")).alias("x"), F.count("*").alias("members"))
    groups = written(groups.select("key", "n", F.col("x.rep").alias("gid"), F.xxhash64("x.rep", "x.d1", "x.d2").alias("row"), "members"), "groups")
    crowded = groups.filter("members > 1").select("key", "n", "gid").join(texts, ["key", "n"]).select("rep", "gid")
    crowded = written(crowded, "members")

    # Only a group's first text is indexed; repeated rows go before they are dealt, so none of them fills a task.
    rows = some.select("n", "prefix", F.col("doc_id").alias("gid"), F.xxhash64("doc_id", "d1", "d2").alias("row"))
    firsts = groups.select("row").hint("merge")
    packed = rows.dropDuplicates(["row"]).join(firsts, "row", "left_semi")
    packed = packed.mapInArrow(_index(ranges, False, sent), "part long, token binary, gid binary, n binary, pos binary")
    lists = written(packed.groupBy("part").applyInArrow(lambda part: _lists(part, longest), "a long, b long, token long, n long, pos long"), "lists")
    hot = rows.mapInArrow(_index(ranges, True, sent), "token long, gid long, row long").join(firsts, "row", "left_semi")
    rows = hot.select("token", "gid").union(lists.filter("b IS NULL").select("token", F.col("a").alias("gid")))
    # Groups of several texts: those that a packed list can hold are paired within, the others are lists themselves.
    small = groups.filter(F.col("members").between(2, longest)).select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    large = groups.filter(F.col("members") > longest).select(F.xxhash64("gid").alias("token"), "gid")
    expand = lambda df, gid, rep: df.join(crowded.select(F.col("gid").alias(gid), F.col("rep").alias(rep)), gid, "left").withColumn(rep, F.coalesce(rep, gid))
    pairs = lists.filter("b IS NOT NULL").select("a", "b").union(small).distinct()
    pairs = expand(expand(pairs, "a", "ra"), "b", "rb").filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    pairs = written(_worth_verifying(written(pairs.distinct(), "pairs"), some), "possible")
    long_ = written(expand(rows.union(large), "gid", "rep").select(F.col("token").alias("list"), F.col("rep").alias("id")).distinct(), "long")

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(long_.select("id")).distinct()
    ids = written(ids.withColumnRenamed("id", "doc_id"), "ids")
    chosen = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = written(chosen.mapInArrow(_whole_sets(size), "id long, tokens binary"), "whole")
    found = [written(_verify(pairs, sets).filter("linked").select("a", "b"), "links")]
    if not long_.isEmpty():
        found += _resolve_long(long_, sets, rounds, work, few)
    labels = components(_union(found))
    final = texts.select("d1", "d2", "n", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    out = every.select("doc_id", "n", "d1", "d2").join(final, ["d1", "d2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
