"""Registered queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from . import bpe, decontam, fingerprints, hamerly, htmlextract, minhash, mixing, negatives, ngramlm, substrings, tokenfiles, toxicity, urlfilter
from .common import table


def op1_document_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_byte_level_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark, sf_dir):
    return substrings.digest(table(spark, sf_dir, "documents"))


def op5_url_filters(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, urlfilter.RULES))


def op6_html_extraction(spark, sf_dir):
    return htmlextract.extract_pages(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark, sf_dir):
    return decontam.digest(decontam.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_token_id_output(spark, sf_dir):
    import public_tokenizers

    files = tokenfiles.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.read_documents(files)


def op9_lm_scoring(spark, sf_dir):
    return ngramlm.score(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark, sf_dir):
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark, sf_dir):
    return hamerly.digest(*hamerly.cluster(table(spark, sf_dir, "embeddings")))


def op13_source_mixing(spark, sf_dir):
    return mixing.allocation(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_document_fingerprints, op2_minhash_near_dedup, op3_byte_level_bpe, op4_suffix_array_dedup, op5_url_filters, op6_html_extraction, op7_benchmark_decontamination, op8_token_id_output, op9_lm_scoring, op10_toxicity, op11_hard_negatives, op12_centroid_clustering, op13_source_mixing)}
