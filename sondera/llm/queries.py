"""The operators' queries and their SQL, by name."""

from __future__ import annotations

from . import alignment, embeddings, jaccard, langid, linededup, mixing, packing, pieces, quality, ranked, secrets, substring, warc

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_warc": warc.op3_warc,
    "op4_quality": quality.op4_quality,
    "op5_mixing": mixing.op5_mixing,
    "op6_secrets": secrets.op6_secrets,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op8_packing": packing.op8_packing,
    "op9_embedding_dedup": embeddings.op9_embedding_dedup,
    "op10_language_id": langid.op10_language_id,
    "op11_alignment": alignment.op11_alignment,
    "op12_ranked_search": ranked.op12_ranked_search,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}
SQL = {"op2_line_dedup": linededup.OP2_SQL, "op3_warc": warc.OP3_SQL, "op12_ranked_search": ranked.OP12_SQL}
