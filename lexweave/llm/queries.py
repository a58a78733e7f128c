"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, language, media, packing, pii, sharding, simhash, substring_dedup, word_bpe, wrapper

QUERIES = {
    "op1_crf_pii": pii.op1_crf_pii,
    "op2_wrapper_induction": wrapper.op2_wrapper_induction,
    "op3_sampled_splitters": sharding.op3_sampled_splitters,
    "op7_subword_language_id": language.op7_subword_language_id,
    "op8_online_packing": packing.op8_online_packing,
    "op10_transducer_bpe": word_bpe.op10_transducer_bpe,
    "op4_tar_media": media.op4_tar_media,
    "op5_multi_index_simhash": simhash.op5_multi_index_simhash,
    "op9_recompression": substring_dedup.op9_recompression,
    "op6_content_sort": exact_dedup.op6_content_sort,
}
ORACLE_SQL = {**exact_dedup.ORACLE}
