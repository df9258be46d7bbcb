"""The queries of this subpackage by name, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from dosewise.llm import (
    bpe,
    collocations,
    language,
    line_dedup,
    merkle,
    minhash,
    mixing,
    multi_index,
    pii,
    quality,
    simple8b,
    token_counts,
    webp_media,
)

QUERIES = {
    f.__name__: f
    for f in (
        webp_media.op1_lossless_webp,
        minhash.op2_circulant_minhash,
        bpe.op3_pair_index_bpe,
        line_dedup.op5_line_windows,
        multi_index.op6_inverted_multi_index,
        language.op7_crf_language,
        quality.op4_pu_quality,
        pii.op8_disguised_pii,
        simple8b.op9_simple8b_tokens,
        mixing.op10_golden_ratio_mix,
        token_counts.op11_pretoken_counts,
        collocations.op12_suffix_collocations,
        merkle.op13_pointer_proofs,
    )
}
ORACLE: dict[str, str] = {
    "op5_line_windows": line_dedup.OP5_SQL,
    "op12_suffix_collocations": collocations.OP12_SQL,
    "op13_pointer_proofs": merkle.OP13_SQL,
}
