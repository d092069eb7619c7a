"""The corpus operators' queries, and the SQL for those that SQL can express."""

from __future__ import annotations

from depotlake.llm import align, bpe, classlm, embeddings, jaccard, langid, licenses, manifest, media, mixing, oracles, secrets, sharding

QUERIES = {f.__name__: f for f in (
    langid.op1_hierarchical_svm, jaccard.op2_bayesian_jaccard_join, media.op3_ogg_media, secrets.op4_credential_linking, bpe.op5_length_histogram,
    embeddings.op6_inverted_multi_index, mixing.op7_temperature_mixing, licenses.op8_conditional_compression, bpe.op9_byte_level_bpe, sharding.op10_sampled_splitters, classlm.op11_brown_classes, align.op12_diagonal_runs, manifest.op13_merkle_manifest,
)}
ORACLES: dict[str, str] = oracles.ORACLES
