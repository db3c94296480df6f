"""The queries of this subpackage and their SQL; __spark_entry__.py adds them if the subpackage is there."""

from __future__ import annotations

from tallyforge.llm import oracle
from tallyforge.llm.bytebpe import op12_byte_bpe
from tallyforge.llm.chat import op9_chat_format
from tallyforge.llm.decontaminate import op7_decontaminate
from tallyforge.llm.langid import op10_language_id
from tallyforge.llm.neardup import op3_minhash
from tallyforge.llm.packing import op4_best_fit_packing
from tallyforge.llm.periodic import op11_periodic_runs
from tallyforge.llm.pii import op1_pii
from tallyforge.llm.prefixtrie import op13_prefix_trie
from tallyforge.llm.quality import op6_quality_rules
from tallyforge.llm.secrets import op5_secret_scan
from tallyforge.llm.substring import op2_substring_dedup
from tallyforge.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_pii": op1_pii,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_minhash": op3_minhash,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontaminate": op7_decontaminate,
    "op10_language_id": op10_language_id,
    "op9_chat_format": op9_chat_format,
    "op8_toxicity": op8_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL = {
    "op2_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op3_minhash": oracle.MINHASH,
    "op6_quality_rules": oracle.QUALITY_RULES,
    "op7_decontaminate": oracle.DECONTAMINATE,
    "op9_chat_format": oracle.CHAT_FORMAT,
    "op13_prefix_trie": oracle.PREFIX_TRIE,
}
