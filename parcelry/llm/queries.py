"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op1_stupid_backoff, op2_secrets, op3_chat_format, op4_kd_shards, op5_toxicity, op6_pivot_index, op7_minhash_bayes, op8_fair_mix, op9_licenses, op10_decontaminate, op11_shared_search, op12_spelling_variants, op13_warc_revisits

QUERIES = {
    "op1_stupid_backoff": op1_stupid_backoff.op1_stupid_backoff,
    "op2_entropy_secrets": op2_secrets.op2_entropy_secrets,
    "op3_template_chat": op3_chat_format.op3_template_chat,
    "op4_kd_tree_shards": op4_kd_shards.op4_kd_tree_shards,
    "op5_subsequence_svm": op5_toxicity.op5_subsequence_svm,
    "op6_pivot_permutation": op6_pivot_index.op6_pivot_permutation,
    "op7_minhash_bayes": op7_minhash_bayes.op7_minhash_bayes,
    "op8_fair_queue_mix": op8_fair_mix.op8_fair_queue_mix,
    "op9_license_dice": op9_licenses.op9_license_dice,
    "op10_spaced_seeds": op10_decontaminate.op10_spaced_seeds,
    "op11_shared_search": op11_shared_search.op11_shared_search,
    "op12_spelling_variants": op12_spelling_variants.op12_spelling_variants,
    "op13_warc_revisits": op13_warc_revisits.op13_warc_revisits,
}
ORACLES = {
    "op1_stupid_backoff": op1_stupid_backoff.ORACLE,
    "op3_template_chat": op3_chat_format.ORACLE,
    "op6_pivot_permutation": op6_pivot_index.ORACLE,
    "op7_minhash_bayes": op7_minhash_bayes.ORACLE,
    "op8_fair_queue_mix": op8_fair_mix.ORACLE,
    "op9_license_dice": op9_licenses.ORACLE,
    "op11_shared_search": op11_shared_search.ORACLE,
    "op12_spelling_variants": op12_spelling_variants.ORACLE,
    "op13_warc_revisits": op13_warc_revisits.ORACLE,
}
