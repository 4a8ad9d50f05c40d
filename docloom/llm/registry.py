"""Queries of this folder and their SQL."""

from __future__ import annotations

from docloom.llm.bpe import op1_bpe
from docloom.llm.html_extract import op3_html_extract
from docloom.llm.jaccard_join import OP10_SQL, op10_jaccard_join
from docloom.llm.katz import op6_katz_backoff
from docloom.llm.mixing import op5_mixing
from docloom.llm.packing import op12_packing
from docloom.llm.quality_classifier import op7_quality_classifier
from docloom.llm.quality_rules import op4_quality_rules
from docloom.llm.secrets import op9_secret_scan
from docloom.llm.spelling import OP11_SQL, op11_spelling
from docloom.llm.telephony import op8_telephony
from docloom.llm.url_filters import OP2_SQL, op2_url_filters
from docloom.llm.vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {f.__name__: f for f in (op1_bpe, op2_url_filters, op3_html_extract, op4_quality_rules, op5_mixing, op6_katz_backoff, op7_quality_classifier, op8_telephony, op9_secret_scan, op10_jaccard_join, op11_spelling, op12_packing, op13_vector_codes)}
ORACLES: dict[str, str] = {"op2_url_filters": OP2_SQL, "op10_jaccard_join": OP10_SQL, "op11_spelling": OP11_SQL, "op13_vector_codes": OP13_SQL}
