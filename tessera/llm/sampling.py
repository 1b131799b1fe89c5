"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import arrow_limits, release


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, learn: Column, per_class: int, longest: int) -> DataFrame:
    """Columns text, label: up to `per_class` documents of each class among rows of `labels` that `learn` admits.

    The choice follows a hash of the id, so it is the same on every run. A document with labels of both kinds counts
    as class 1; other values and nulls are left out, as are texts over `longest` characters. Its size is bounded by
    per_class and longest, whatever the tables hold.
    """
    marked = labels.filter(learn & F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).alias("label"))
    order = F.xxhash64("doc_id")
    picked = [marked.filter(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    ids = picked[0].union(picked[1])
    texts = docs.select("doc_id", "text").filter(F.length("text") <= longest)
    rows = texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    return rows.orderBy(order, "doc_id").select("text", F.col("label").cast("int").alias("label")).limit(2 * per_class)


def fitted(sample: DataFrame, train: Callable[[pa.Array, np.ndarray], object]):
    """train(texts, labels) over a bounded sample, in one task: the driver holds the finished model only, never the texts.

    An empty sample is trained on as well. A task that is lost is run again and learns the same.
    """
    arrow_limits(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        texts = pa.concat_arrays([b.column("text").cast(pa.string()) for b in held]) if held else pa.array([], pa.string())
        labels = np.concatenate([b.column("label").to_numpy() for b in held]) if held else np.zeros(0, np.int64)
        held.clear()
        model = pickle.dumps(train(texts, labels))
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    model = pickle.loads(found[0]["model"]) if found else train(pa.array([], pa.string()), np.zeros(0, np.int64))
    release()
    return model
