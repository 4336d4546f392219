"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import fingerprints, html_extract, langid, nbest, ngram_join, packing, quality, sharding, token_counts, urlfilter

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_sharding": sharding.query,
    "op3_sentencepiece_nbest": nbest.query,
    "op4_language_id": langid.query,
    "op5_url_filter": urlfilter.query,
    "op6_packing": packing.query,
    "op7_ngram_jaccard_join": ngram_join.query,
    "op8_fingerprints": fingerprints.query,
    "op9_html_extraction": html_extract.query,
    "op10_token_counts": token_counts.query,
}
ORACLES = {"op1_quality_rules": quality.ORACLE_SQL, "op2_sharding": sharding.ORACLE_SQL, "op5_url_filter": urlfilter.ORACLE_SQL, "op7_ngram_jaccard_join": ngram_join.ORACLE_SQL}
