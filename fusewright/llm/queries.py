"""The subpackage's queries and their SQL."""
from __future__ import annotations

from fusewright.llm.byte_bpe import op9_byte_bpe
from fusewright.llm.chat_format import OP7_SQL, op7_chat_format
from fusewright.llm.decontamination import OP10_SQL, op10_decontamination
from fusewright.llm.embedding_dedup import OP1_SQL, op1_embedding_dedup
from fusewright.llm.html_extract import op8_html_extract
from fusewright.llm.lexical_search import OP12_SQL, op12_lexical_search
from fusewright.llm.line_dedup import OP13_SQL, op13_line_dedup
from fusewright.llm.ngram_jaccard import OP3_SQL, op3_ngram_jaccard
from fusewright.llm.rolling_features import OP11_SQL, op11_rolling_features
from fusewright.llm.secret_scan import op5_secret_scan
from fusewright.llm.token_counts import op4_token_counts
from fusewright.llm.toxicity import op2_toxicity
from fusewright.llm.url_filter import op6_url_filter

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_token_counts": op4_token_counts,
    "op5_secret_scan": op5_secret_scan,
    "op6_url_filter": op6_url_filter,
    "op7_chat_format": op7_chat_format,
    "op8_html_extract": op8_html_extract,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_decontamination": op10_decontamination,
    "op11_rolling_features": op11_rolling_features,
    "op12_lexical_search": op12_lexical_search,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": OP1_SQL,
    "op3_ngram_jaccard": OP3_SQL,
    "op7_chat_format": OP7_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_rolling_features": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
