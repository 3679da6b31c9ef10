"""The subpackage's registered queries.  SQL that runs on whole tables exists for
op5 only (DuckDB has no crc32, no compression and no model fitting); the others
are held against brute force, round trips or held-out labels by their tests."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_lexical_packing": "packing",
    "op2_importance_quality": "quality",
    "op3_token_files": "token_files",
    "op4_prefix_bpe": "prefix_bpe",
    "op5_stream_dedup": "stream_dedup",
    "op6_toxic_sentences": "toxicity",
    "op7_stratified_interleaving": "sharding",
    "op8_language_evidence": "language",
    "op9_weighted_near_dedup": "near_dedup",
    "op10_license_compression": "licenses",
    "op11_periodic_runs": "periodic_runs",
    "op12_embedding_whitening": "whitening",
    "op13_fourier_quality": "quality_scores",
}
QUERIES = {name: getattr(import_module(f"skyledger.llm.{module}"), name) for name, module in _MODULES.items()}
ORACLE: dict[str, str] = {
    "op5_stream_dedup": r"""SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
        row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, length(coalesce(text, '')) AS chars,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
        WINDOW w AS (PARTITION BY t ORDER BY chars DESC, doc_id)""",
}
