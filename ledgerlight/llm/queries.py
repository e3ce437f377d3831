"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from ledgerlight.llm.chat import op3_chat
from ledgerlight.llm.decontam import op7_decontamination
from ledgerlight.llm.html import op2_html
from ledgerlight.llm.langid import op1_langid
from ledgerlight.llm.lm import op9_lm_scoring
from ledgerlight.llm.minhash import op12_minhash
from ledgerlight.llm.negatives import op13_hard_negatives
from ledgerlight.llm.oracles import OP3, OP4, OP9, OP10, OP12, OP13
from ledgerlight.llm.packing import op6_packing
from ledgerlight.llm.quality import op8_quality
from ledgerlight.llm.sentences import op10_sentence_dedup
from ledgerlight.llm.simhash import op5_simhash
from ledgerlight.llm.suffix import op4_suffix_dedup
from ledgerlight.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_langid, op2_html, op3_chat, op4_suffix_dedup, op5_simhash, op6_packing, op7_decontamination, op8_quality, op9_lm_scoring, op10_sentence_dedup, op11_whitening, op12_minhash, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op3_chat": OP3, "op4_suffix_dedup": OP4, "op9_lm_scoring": OP9, "op10_sentence_dedup": OP10, "op12_minhash": OP12, "op13_hard_negatives": OP13}
