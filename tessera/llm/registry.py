"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from tessera.llm import decontaminate, language_model, license_scan, packing, quality, topk, toxicity, warc
from tessera.llm.ngram_join import similar_components
from tessera.llm.shared import table
from tessera.llm.token_counts import length_histogram, suffix_totals


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"), license_scan.known_licences(spark))


def op4_ngram_jaccard_join(spark, sf_dir):
    return similar_components(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_exact_topk(spark, sf_dir):
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_products(vectors.filter("vec_id % 50 = 0"), vectors)


def op7_lm_scoring(spark, sf_dir):
    return language_model.held_out_scores(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return suffix_totals(length_histogram(table(spark, sf_dir, "documents")))


def op9_quality(spark, sf_dir):
    return quality.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_warc": op5_warc,
    "op6_exact_topk": op6_exact_topk,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
}
ORACLES: dict[str, str] = {
    "op3_license_scan": license_scan.oracle_sql(),
    "op5_warc": warc.oracle_sql(),
    "op6_exact_topk": topk.oracle_sql(),
    "op10_decontamination": decontaminate.oracle_sql(),
}
