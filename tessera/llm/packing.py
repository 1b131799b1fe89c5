"""Conflict-constrained best-fit packing of documents into training windows.

Documents are dealt over shards of bounded size by a hash of their row and packed within a shard, longest first; equal
rows are counted first and dealt in blocks, so that any number of them spreads over the shards. Open
bins stand in order of what is left in them and carry bitmaps of the sources and duplicate clusters they hold. For an
item the search starts at the tightest bin it fits and goes on to the next until one has neither its source nor its
cluster; without any a new bin opens. A text longer than a bin fills bins of its own with whole pieces; what is left of
it is an item like others.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Words, arrow_limits, mix, text_blocks, written

#: Words a bin holds.
CAPACITY = 2048
#: Expected documents of a shard.
SHARD_ROWS = 4096

PACKED = "shard long, bin long, doc_id long, piece long, first_word long, n_words long"


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each item. Items come in descending size, ties in the given order; empty items go to bin -1.

    No bin holds two items of one source or of one cluster; None conflicts with nothing.
    """
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    source_bit = {s: k for k, s in enumerate(dict.fromkeys(x for x in sources if x is not None))}
    cluster_bit = {c: k for k, c in enumerate(dict.fromkeys(x for x in clusters if x is not None))}
    many: dict = {}
    for c in clusters:
        many[c] = many.get(c, 0) + 1
    open_: list[tuple[int, int]] = []  # (left, bin) ascending
    held_sources: list[int] = []
    held_clusters: list[int] = []
    # Bins that are alike in what is left and in sources share a run of the order; a full bin leaves it.
    bins = [-1] * len(sizes)
    for k in order:
        size = sizes[k]
        if size == 0:
            continue
        s = 0 if sources[k] is None else 1 << source_bit[sources[k]]
        c = 0 if clusters[k] is None or many[clusters[k]] == 1 else 1 << cluster_bit[clusters[k]]
        at = bisect_left(open_, (size, -1))
        while at < len(open_) and (held_sources[open_[at][1]] & s or held_clusters[open_[at][1]] & c):
            at += 1
        if at < len(open_):
            left, b = open_.pop(at)
            held_sources[b] |= s
            held_clusters[b] |= c
        else:
            left, b = capacity, len(held_sources)
            held_sources.append(s)
            held_clusters.append(c)
        bins[k] = b
        if left > size:
            insort(open_, (left - size, b))
    return bins


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text and a hash of its word sequence, by which equal texts are one cluster."""
    for batch in text_blocks(batches, "text"):
        words = Words(batch.column("text"))
        n = np.diff(words.offsets)
        place = np.arange(len(words.hashes), dtype=np.uint64) - np.repeat(words.offsets[:-1], n).astype(np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(mix(words.hashes + place * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64))
        cluster = (sums[words.offsets[1:]] - sums[words.offsets[:-1]]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64()), pa.array(cluster)], ["doc_id", "source", "n_words", "cluster"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words and cluster (equal word sequences, case folded) of each document."""
    arrow_limits(docs.sparkSession)
    return docs.select("doc_id", "source", "text").mapInArrow(_measure, "doc_id long, source string, n_words long, cluster long")


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard, so a task packs one shard after the other."""
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["shard"] != row["shard"]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    def flush(rows: list[dict]) -> pa.RecordBatch:
        bins = best_fit([r["n_words"] % capacity for r in rows], [r["source"] for r in rows], [r["cluster"] for r in rows], capacity)
        fresh = max(bins, default=-1) + 1
        out = []
        for r, b in zip(rows, bins):
            whole, rest = divmod(r["n_words"], capacity)
            pieces = [capacity] * whole + ([rest] if rest else [])
            for k, size in enumerate(pieces):
                at = b
                if k < whole:
                    at, fresh = fresh, fresh + 1
                out.append((r["shard"], at, r["doc_id"], k, k * capacity, size))
            if not pieces:
                out.append((r["shard"], -1, r["doc_id"], 0, 0, 0))
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["shard", "bin", "doc_id", "piece", "first_word", "n_words"])

    return run


def pack_documents(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """shard, bin, doc_id, piece, first_word, n_words: where each piece of each document lies.

    items holds doc_id, source, n_words and cluster. Bins are numbered within their shard. A document without words
    (null or empty text) has one row with bin -1. Repeated rows are packed each; a null source or cluster conflicts
    with nothing; rows with a null doc_id are packed as well. Other columns are not read. An empty table gives no rows.
    The result depends on the rows alone, not on how they lie.
    """
    spark = items.sparkSession
    arrow_limits(spark)
    items = items.select("doc_id", "source", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), "cluster")
    shards = max(1, -(-items.count() // shard_rows))
    # Equal rows are interchangeable: they travel as a count, a block of them to a shard, and are unfolded there.
    block = max(1, shard_rows // 8)
    row = ["doc_id", "source", "n_words", "cluster"]
    counted = items.groupBy(*row).agg(F.count("*").alias("many"))
    blocks = counted.select(*row, "many", F.explode(F.expr(f"sequence(0, (many - 1) div {block})")).alias("block"))
    dealt = blocks.withColumn("shard", F.pmod(F.xxhash64(*row, "block"), F.lit(shards))).repartition("shard")
    copies = F.expr(f"sequence(1, least({block}, many - block * {block}))")
    rows = dealt.select("shard", *row, F.explode(copies).alias("copy")).drop("copy")
    rows = rows.sortWithinPartitions("shard", F.desc("n_words"), *row[:2], "cluster")
    return rows.mapInArrow(_pack(capacity), PACKED)


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Measure the whole texts of docs and pack them."""
    return pack_documents(written(measured(docs), "measured"), capacity, shard_rows)
