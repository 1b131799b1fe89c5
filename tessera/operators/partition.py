"""Radix partitioning: histograms, padded offsets, scatter positions and physical placement.

A relation has columns key, value and pos (its place, 0..n-1). Chunks are runs of places; the last takes the remainder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.radix import RadixBits

#: Bytes of alignment of chunks and padding of partitions.
ALIGN = 128


def padding(tuple_bytes: int) -> int:
    """Tuples of padding before a partition."""
    return ALIGN // tuple_bytes


def chunk_length(rows: int, chunks: int, key_bytes: int) -> int:
    """Rows of a chunk: ceil(rows / chunks), rounded down to the alignment; 0 when chunks are tiny."""
    step = ALIGN // key_bytes
    return -(-rows // chunks) // step * step


def with_chunks(rows: DataFrame, count: int, chunks: int, key_bytes: int = 8) -> DataFrame:
    """rows with chunk_id; where the aligned length is 0 all rows lie in the last chunk."""
    size = chunk_length(count, chunks, key_bytes)
    chunk = F.least(F.floor(F.col("pos") / size), F.lit(chunks - 1)) if size else F.lit(chunks - 1)
    return rows.withColumn("chunk_id", chunk.cast("int"))


def with_partition(rows: DataFrame, bits: RadixBits, number: int = 1) -> DataFrame:
    return rows.withColumn("partition_id", bits.partition_id(F.col("key"), number).cast("int"))


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    """cnt for each combination of `by`; counted partially before the exchange, so hot partitions cost one row a task."""
    return rows.groupBy(*by).agg(F.count("*").alias("cnt"))


def full_histogram(rows: DataFrame, fanout: int, chunks: int = 1) -> DataFrame:
    """cnt for every (chunk_id, partition_id), absent ones with 0."""
    spark = rows.sparkSession
    grid = spark.range(chunks * fanout).select(F.floor(F.col("id") / fanout).cast("int").alias("chunk_id"), (F.col("id") % fanout).cast("int").alias("partition_id"))
    return grid.join(histogram(rows, "chunk_id", "partition_id"), ["chunk_id", "partition_id"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def chunked_offsets(counts: DataFrame, chunk_rows: int, fanout: int, pad: int) -> DataFrame:
    """offset of each (chunk_id, partition_id): chunks lie apart, each partition is preceded by `pad` tuples."""
    before = Window.partitionBy("chunk_id").orderBy("partition_id").rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("chunk_id").cast("long") * (chunk_rows + pad * fanout)
    offset = base + pad * (F.col("partition_id") + 1) + F.coalesce(F.sum("cnt").over(before), F.lit(0))
    return counts.withColumn("offset", offset.cast("long"))


def contiguous_offsets(counts: DataFrame, pad: int) -> DataFrame:
    """offset of each (chunk_id, partition_id) when a partition's chunks lie together, one padding for each partition.

    Counts are summed by partition first; the running sum over partitions goes over those totals only.
    """
    totals = counts.groupBy("partition_id").agg(F.sum("cnt").alias("total"))
    before = Window.orderBy("partition_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("partition_id", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("partition_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("base") + pad * (F.col("partition_id") + 1) + F.coalesce(F.sum("cnt").over(inside), F.lit(0))
    return counts.join(totals, "partition_id").withColumn("offset", offset.cast("long")).drop("base")


def local_offsets(counts: DataFrame) -> DataFrame:
    """local_offset: where a partition begins within its chunk, without padding."""
    before = Window.partitionBy("chunk_id").orderBy("partition_id").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("local_offset", F.coalesce(F.sum("cnt").over(before), F.lit(0)).cast("long"))


def partition_lengths(counts: DataFrame) -> DataFrame:
    return counts.groupBy("partition_id").agg(F.sum("cnt").alias("len"))


#: Places in one block of the two-level ranks.
RANK_BLOCK = 100_000


def scatter_slots(rows: DataFrame, offsets: DataFrame, block: int = RANK_BLOCK) -> DataFrame:
    """slot of each row: its partition's offset plus its rank by place among the partition's rows of its chunk.

    Ranks go in two levels: rows are counted by blocks of `block` places, the counts' running sums (one row a block)
    give each block its base, and rows are numbered within their block only, so no task sorts a whole partition.
    """
    keys = ["chunk_id", "partition_id"]
    rows = rows.withColumn("_block", F.floor(F.col("pos") / block))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    bases = bases.join(offsets.select(*keys, "offset"), keys).select(*keys, "_block", (F.col("offset") + F.col("_base")).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_block", *keys).orderBy("pos")) - 1
    placed = rows.withColumn("_rank", inside).join(bases, [*keys, "_block"])
    return placed.withColumn("slot", F.col("_base") + F.col("_rank")).drop("_base", "_rank", "_block")


def partition(rows: DataFrame, bits: RadixBits) -> DataFrame:
    """rows placed so that task k holds exactly radix id k (all passes in one exchange), with p1..p3 and the id."""
    for k in range(1, len(bits.passes) + 1):
        rows = rows.withColumn(f"p{k}", bits.partition_id(F.col("key"), k).cast("int"))
    return rows.withColumn("pid", bits.combined_id(F.col("key")).cast("int")).repartitionById(bits.fanout(), "pid")


def partition_slice(rows: DataFrame, partition_id: int, chunk_id: int | None = None) -> DataFrame:
    """Rows of one partition, of one chunk if given."""
    rows = rows.filter(F.col("partition_id") == partition_id)
    return rows if chunk_id is None else rows.filter(F.col("chunk_id") == chunk_id)


def partition_capacity(counts: DataFrame, pad: int, tuple_bytes: int) -> DataFrame:
    """len, padded_len and bytes of each partition: the room it takes with its padding before it."""
    padded = F.col("len") + pad
    return partition_lengths(counts).withColumn("padded_len", padded).withColumn("bytes", padded * tuple_bytes)


def copy_with_payload(rows: DataFrame, bits: RadixBits) -> tuple[DataFrame, DataFrame]:
    """(key and value with their partition, counts by partition): one copy serves the count and what follows."""
    copied = with_partition(rows.select("key", "value"), bits)
    return copied, histogram(copied, "partition_id")


def transform_partition(rows: DataFrame, partition_id: int) -> DataFrame:
    """One partition's tuples as columns, chunks one after the other (ordered by chunk_id, pos)."""
    return partition_slice(rows, partition_id).select("chunk_id", "pos", "key", "value").orderBy("chunk_id", "pos")


def assign_tasks(counts: DataFrame, workers: int) -> DataFrame:
    """worker of each partition (partition_id, cnt dense from 0): runs of partitions, cut after the one that reaches the
    mean load; the last worker takes the rest. Greedy and sequential over the histogram's few rows, which are folded
    in one expression that keeps the places of the cuts only; the relation itself is not touched."""
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("partition_id", F.col("cnt").cast("long").alias("cnt")))).alias("c"))
    mean = F.ceil(F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x["cnt"]) / workers).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("load"), F.array().cast("array<bigint>").alias("cuts"))

    def step(state, x):
        full = (state["load"] + x["cnt"] >= F.col("mean")) & (F.size(state["cuts"]) < workers - 1)
        return F.struct(
            F.when(full, F.lit(0).cast("long")).otherwise(state["load"] + x["cnt"]).alias("load"),
            F.when(full, F.concat(state["cuts"], F.array(x["partition_id"].cast("long")))).otherwise(state["cuts"]).alias("cuts"),
        )

    cuts = listed.withColumn("mean", mean).select(F.aggregate("c", start, step)["cuts"].alias("cuts"))
    worker = 1 + F.size(F.filter("cuts", lambda c: c < F.col("partition_id"))).cast("long")
    return counts.crossJoin(F.broadcast(cuts)).select("partition_id", F.col("cnt").cast("long").alias("cnt"), worker.alias("worker"))
