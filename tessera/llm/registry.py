"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm.decontaminate import OP9_SQL, op9_decontamination
from tessera.llm.htmltext import op7_html
from tessera.llm.mixing import OP1_SQL, op1_mixing
from tessera.llm.neighbours import op3_neighbours
from tessera.llm.quality import op8_quality
from tessera.llm.sharding import op5_sharding
from tessera.llm.simhash import op2_simhash
from tessera.llm.tokens import op6_token_counts
from tessera.llm.toxicity import op10_toxicity
from tessera.llm.urlfilter import OP4_SQL, op4_url_filter

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_neighbours": op3_neighbours,
    "op4_url_filter": op4_url_filter,
    "op5_sharding": op5_sharding,
    "op6_token_counts": op6_token_counts,
    "op7_html": op7_html,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL = {
    "op1_mixing": OP1_SQL,
    "op4_url_filter": OP4_SQL,
    "op9_decontamination": OP9_SQL,
}
