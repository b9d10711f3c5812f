"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP2_SQL, op2_chat_format
from .decontaminate import op7_decontaminate
from .html import op4_html_extraction
from .lines import OP9_SQL, op9_line_dedup
from .minhash import OP8_SQL, op8_minhash_dedup
from .passages import OP5_SQL, op5_substring_dedup
from .pieces import op3_sentencepiece
from .prefixes import OP12_SQL, op12_conversation_prefix_trie
from .quality import op10_quality_rules
from .runs import op11_periodic_runs
from .secrets import op1_secret_scans
from .suffixes import op6_suffix_array_dedup
from .urls import OP13_SQL, op13_url_filters

QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_chat_format": op2_chat_format,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_html_extraction": op4_html_extraction,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_url_filters": op13_url_filters,
}

#: The other queries are tested against brute force: their rows need iteration,
#: a tokeniser, a parser or positions of matches, which SQL lacks.
ORACLE_SQL = {
    "op2_chat_format": OP2_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op8_minhash_dedup": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
    "op12_conversation_prefix_trie": OP12_SQL,
    "op13_url_filters": OP13_SQL,
}
