"""The registered queries of this package and their DuckDB twins."""

from __future__ import annotations

from plenum.llm import alignment, fingerprints, langid, licenses, mixing, neardup, packing, personal, prefixes, quality, secrets, shards, topk

QUERIES = {"op1_language_id": langid.op1, "op2_source_mixing": mixing.op2, "op3_packing": packing.op3, "op4_secret_scans": secrets.op4, "op5_document_fingerprints": fingerprints.op5, "op6_exact_topk": topk.op6, "op7_quality_resampling": quality.op7, "op8_license_scans": licenses.op8, "op9_ngram_jaccard_join": neardup.op9, "op10_sharding": shards.op10, "op11_token_alignment": alignment.op11, "op12_personal_data": personal.op12, "op13_conversation_trie": prefixes.op13}
ORACLE_SQL = {"op4_secret_scans": secrets.ORACLE, "op8_license_scans": licenses.ORACLE, "op6_exact_topk": topk.ORACLE, "op13_conversation_trie": prefixes.ORACLE}
