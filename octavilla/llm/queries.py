"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import (
    contamination, embeddings, fingerprints, mixing, near_copies, packing, periodic, quality, suffixes, token_files, toxicity, warc, whitening)


def _pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_soft_mixing": mixing.op1_soft_mixing,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_token_files": token_files.op3_token_files,
    "op4_quality_grades": quality.op4_quality_grades,
    "op5_order_minhash": fingerprints.op5_order_minhash,
    "op6_suffix_repeats": suffixes.op6_suffix_repeats,
    "op7_near_copies": near_copies.op7_near_copies,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_warc_transactions": warc.op9_warc_transactions,
    "op10_embedding_near_copies": embeddings.op10_embedding_near_copies,
    "op11_benchmark_overlap": contamination.op11_benchmark_overlap,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
    "pipeline": _pipeline,
}

ORACLES: dict[str, str] = {}
