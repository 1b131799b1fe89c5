"""Exact token totals from a histogram of encoded lengths.

Every text is encoded whole; documents are then counted by length, and sums over the histogram's suffixes answer
totals, quantiles and truncated totals for every context limit without another pass over the texts.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import arrow_limits, text_blocks, written

#: Folder of the public vocabulary files; a parameter of every function that encodes.
VOCABULARIES = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Pattern that splits texts for this vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of so many blanks, and words of so many characters, are not given to the pattern: its look-ahead would recurse over them.
LONG_RUN = 2000
#: White space as the pattern has it. Fixed value.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
#: Lengths in one block of the two-level running sums.
BLOCK_WIDTH = 128


@lru_cache(4)
def encoding(folder: str = VOCABULARIES, name: str = RANKS):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | None, encoder) -> int:
    """Tokens of the whole text; 0 for null and empty ones.

    A long run of blanks is encoded on its own: the pattern takes all of it but the last blank, which goes with what
    follows (or all of it at the text's end), so the parts have the tokens of the whole.
    """
    if not text:
        return 0
    total = at = 0
    if len(text) >= LONG_RUN:
        for run in _BLANKS.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            total += len(encoder.encode_ordinary(text[at : run.start()])) + len(encoder._core_bpe.encode_single_piece(text[run.start() : end].encode()))
            at = end
    return total + len(encoder.encode_ordinary(text[at:]))


def _lengths(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(folder, name)
        for batch in text_blocks(batches, "text"):
            sizes = [token_count(t, encoder) for t in batch.column("text").to_pylist()]
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(sizes, pa.int64())], [*others, "n_tokens"])

    return run


def token_lengths(docs: DataFrame, folder: str = VOCABULARIES, name: str = RANKS) -> DataFrame:
    """doc_id and n_tokens of each whole text; null and empty texts have 0 tokens. Repeated rows count each, null ids stay,
    texts of any length (blanks only, one word) are encoded whole. Columns other than these two are not read; an empty
    table gives no rows."""
    arrow_limits(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_lengths(folder, name), "doc_id long, n_tokens long")


def _counted(folder: str, name: str):
    """Each task's documents by length: at most one row a length leaves the task."""
    lengths = _lengths(folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in lengths(batches):
            for size, n in zip(*np.unique(batch.column("n_tokens").to_numpy(), return_counts=True)):
                found[int(size)] = found.get(int(size), 0) + int(n)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n_tokens", "documents"])

    return run


def length_histogram(docs: DataFrame, folder: str = VOCABULARIES, name: str = RANKS) -> DataFrame:
    """(n_tokens, documents) for each encoded length that occurs: null and empty texts count under 0, repeated rows each.

    Only the text is read, so ids may be null and other columns may have any name. An empty table gives no rows.
    """
    arrow_limits(docs.sparkSession)
    counted = docs.select("text").mapInArrow(_counted(folder, name), "n_tokens long, documents long")
    return counted.groupBy("n_tokens").agg(F.sum("documents").alias("documents"))


def suffix_totals(histogram: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """For each length L of the histogram: documents and tokens of that length, those of L and more (docs_from,
    tokens_from), those below (docs_below, tokens_below), the share of documents up to L (quantile) and the total when
    every text is cut at L (truncated_tokens = tokens_below + L * docs_from).

    A limit between two lengths is answered by the next longer one's docs_from and tokens_below. Running sums go by
    blocks of `width` lengths, then over the blocks' totals, so no task sees more than one block of a long histogram.
    An empty histogram gives no rows. The histogram is written first: it is read twice, the texts behind it once.
    """
    histogram = written(histogram.select("n_tokens", "documents"), "lengths")
    rows = histogram.select("n_tokens", "documents", (F.col("n_tokens") * F.col("documents")).alias("tokens"), F.floor(F.col("n_tokens") / width).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(before), zero).alias("d0"), F.coalesce(F.sum("t").over(before), zero).alias("t0"), F.sum("d").over(all_).alias("dn"), F.sum("t").over(all_).alias("tn"))
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(blocks, "block")
    rows = rows.withColumn("docs_below", F.col("d0") + F.coalesce(F.sum("documents").over(inside), zero))
    rows = rows.withColumn("tokens_below", F.col("t0") + F.coalesce(F.sum("tokens").over(inside), zero))
    docs_from = F.col("dn") - F.col("docs_below")
    return rows.select(
        "n_tokens", "documents", "tokens", "docs_below", "tokens_below", docs_from.alias("docs_from"), (F.col("tn") - F.col("tokens_below")).alias("tokens_from"),
        (F.col("tokens_below") + F.col("n_tokens") * docs_from).alias("truncated_tokens"), ((F.col("docs_below") + F.col("documents")) / F.col("dn")).alias("quantile"),
    )


def quantile_length(totals: DataFrame, share: float) -> DataFrame:
    """The least length that `share` of the documents do not exceed."""
    return totals.filter(F.col("quantile") >= share - 1e-12).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(totals: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every text is cut at `limit`; 0 for an empty histogram."""
    tail = totals.filter(F.col("n_tokens") >= limit).agg(F.min_by(F.struct("tokens_below", "docs_from"), "n_tokens").alias("x"))
    whole = totals.agg(F.sum("tokens").alias("all"))
    return tail.crossJoin(whole).select(F.coalesce(F.col("x.tokens_below") + limit * F.col("x.docs_from"), "all", F.lit(0)).cast("long").alias("tokens"))
