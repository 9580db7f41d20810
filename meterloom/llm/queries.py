"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import attention, decontam, divergence, linededup, mixing, neardup, periodic, pii, quality, sharding, tokens, urlfilter, warc

QUERIES = {
    "op2_tensored_minhash": neardup.grouped_documents,
    "op1_weak_supervision": quality.judged_documents,
    "op3_patched_frames": tokens.encoded_documents,
    "op4_poisson_mixing": mixing.mixed_documents,
    "op5_digest_array": urlfilter.judged_pages,
    "op6_levelled_runs": linededup.deduplicated_documents,
    "op7_feistel_pseudonyms": pii.pseudonymised_documents,
    "op8_positional_index": decontam.judged_documents,
    "op9_two_pass_shuffle": sharding.sharded_documents,
    "op10_seekable_bundles": warc.archived_pages,
    "op11_pattern_tree": divergence.audited_sources,
    "op12_attention_passages": attention.classified_documents,
    "op13_block_convolution": periodic.collapsed_documents,
}

ORACLE_SQL = {
    "op2_tensored_minhash": neardup.GROUPED_SQL,
    "op4_poisson_mixing": mixing.MIXED_SQL,
    "op5_digest_array": urlfilter.JUDGED_SQL,
    "op6_levelled_runs": linededup.DEDUPLICATED_SQL,
    "op8_positional_index": decontam.JUDGED_SQL,
    "op10_seekable_bundles": warc.ARCHIVED_SQL,
    "op11_pattern_tree": divergence.AUDITED_SQL,
}
