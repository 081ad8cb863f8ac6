"""The queries of this package and their SQL."""

from rastrel.llm.bpe import op9_bpe
from rastrel.llm.line_dedup import OP8_SQL, op8_line_dedup
from rastrel.llm.mixing import OP10_SQL, op10_mixing
from rastrel.llm.pitman_yor import op4_pitman_yor
from rastrel.llm.quality_rules import OP3_SQL, op3_quality_rules
from rastrel.llm.simhash import op6_simhash
from rastrel.llm.toxicity import op1_toxicity
from rastrel.llm.url_filter import OP5_SQL, op5_url_filter
from rastrel.llm.vector_topk import OP2_SQL, op2_exact_topk
from rastrel.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_exact_topk, op3_quality_rules, op4_pitman_yor, op5_url_filter, op6_simhash, op7_warc, op8_line_dedup, op9_bpe, op10_mixing)
}
ORACLE_SQL = {
    "op2_exact_topk": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "op5_url_filter": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_mixing": OP10_SQL,
}
