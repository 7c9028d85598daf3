"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from quern.llm.alignment import op12_cross_tokenizer
from quern.llm.decontaminate import OP3_SQL, op3_decontamination
from quern.llm.mixing import OP7_SQL, op7_poisson_mixing
from quern.llm.pieces import op11_sentencepiece
from quern.llm.quality import OP1_SQL, op1_quality_rules
from quern.llm.ranked import OP13_SQL, op13_ranked_search
from quern.llm.secrets import op10_secret_ownership
from quern.llm.simhash import op8_simhash
from quern.llm.substrings import OP2_SQL, op2_substring_dedup
from quern.llm.tokens import op9_token_planes
from quern.llm.toxicity import op4_toxicity
from quern.llm.urls import OP6_SQL, op6_host_reputation
from quern.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_substring_dedup, op3_decontamination, op4_toxicity, op5_warc, op6_host_reputation, op7_poisson_mixing, op8_simhash, op9_token_planes, op10_secret_ownership, op11_sentencepiece, op12_cross_tokenizer, op13_ranked_search)
}
SQL = {
    "op1_quality_rules": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op3_decontamination": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op6_host_reputation": OP6_SQL,
    "op7_poisson_mixing": OP7_SQL,
    "op13_ranked_search": OP13_SQL,
}
