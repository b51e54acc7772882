"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import ann, chat, decontam, langid, lexical, linededup, mixing, ngram_join, pii, quality, secrets, urlfilter, whitening

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_mix": mixing.op3_mix,
    "op4_chat_format": chat.op4_chat_format,
    "op5_langid": langid.op5_langid,
    "op6_quality": quality.op6_quality,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_nearest": ann.op9_nearest,
    "op10_line_dedup": linededup.op10_line_dedup,
    "op11_lexical": lexical.op11_lexical,
    "op12_whitening": whitening.op12_whitening,
    "op13_pii": pii.op13_pii,
}
ORACLE_SQL = {"op2_ngram_join": ngram_join.OP2_SQL, "op3_mix": mixing.OP3_SQL, "op7_url_filter": urlfilter.OP7_SQL, "op11_lexical": lexical.OP11_SQL}
