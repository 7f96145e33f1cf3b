"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import binary_packing, centroids, decontaminate, divergence, html_text, lang_id, licenses, lm_score, near_dup, packing, quality, sharding, url_filter

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_lm_scoring": lm_score.op3_lm_scoring,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_sharding": sharding.op8_sharding,
    "op9_language_id": lang_id.op9_language_id,
    "op10_near_duplicates": near_dup.op10_near_duplicates,
    "op11_binary_packing": binary_packing.op11_binary_packing,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.oracle_sql(),
    "op2_decontamination": decontaminate.oracle_sql(),
    "op6_url_filter": url_filter.oracle_sql(),
    "op7_license_scan": licenses.oracle_sql(),
    "op8_sharding": sharding.oracle_sql(),
    "op12_source_divergence": divergence.oracle_sql(),
    "op13_centroid_clustering": centroids.oracle_sql(),
}
