"""python -m tessera.sources.cli OUT_DIR --data-set blanas: writes a primary-key and a foreign-key relation."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera.session import local_session
from tessera.sources.generators import DataSet, join_input, preset
from tessera.sources.relations import write_relation


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("out")
    p.add_argument("--data-set", default="custom")
    p.add_argument("--inner", type=int, default=1000)
    p.add_argument("--outer", type=int, default=10_000)
    p.add_argument("--zipf-exponent", type=float, default=0.0)
    p.add_argument("--selectivity", type=int, default=100)
    p.add_argument("--scale", type=float, default=1.0)
    p.add_argument("--tuple-bytes", type=int, choices=(8, 16), default=16)
    p.add_argument("--kind", choices=("csv", "tsv"), default="tsv")
    p.add_argument("--no-compress", action="store_true")
    p.add_argument("--payload-below", type=int, help="draw payloads from 0 up to this number instead of numbering them")
    a = p.parse_args(argv)
    payload = (0, a.payload_below) if a.payload_below else None
    data = DataSet(a.inner, a.outer, a.zipf_exponent, payload=payload) if a.data_set == "custom" else preset(a.data_set, a.tuple_bytes // 2)
    # Under spark-submit the running session is used; by itself the command opens a local one.
    spark = SparkSession.getActiveSession() or local_session()
    for name, rows in zip(("inner", "outer"), join_input(spark, data, a.selectivity, a.scale)):
        write_relation(rows, f"{a.out}/{name}", a.kind, not a.no_compress)


if __name__ == "__main__":
    main()
