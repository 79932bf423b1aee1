"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from kerege.llm.clustering import OP11_SQL, op11_lloyd
from kerege.llm.decontamination import OP4_SQL, op4_spaced_seeds
from kerege.llm.html_text import op8_text_blocks
from kerege.llm.licences import op6_fuzzy_notices
from kerege.llm.line_quality import op7_line_field
from kerege.llm.packing import op5_grouping_genetic
from kerege.llm.quality_rules import op3_outliers
from kerege.llm.recompression import OP2_SQL, op2_recompression
from kerege.llm.simhash import op1_simhash
from kerege.llm.tokens import op9_rank_synchronous
from kerege.llm.toxicity import op10_kneser_ney
from kerege.llm.vector_codes import OP13_SQL, op13_screened_codes
from kerege.llm.warc import OP12_SQL, op12_warc_index

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_recompression": op2_recompression,
    "op3_outliers": op3_outliers,
    "op4_spaced_seeds": op4_spaced_seeds,
    "op5_grouping_genetic": op5_grouping_genetic,
    "op6_fuzzy_notices": op6_fuzzy_notices,
    "op7_line_field": op7_line_field,
    "op8_text_blocks": op8_text_blocks,
    "op9_rank_synchronous": op9_rank_synchronous,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_lloyd": op11_lloyd,
    "op12_warc_index": op12_warc_index,
    "op13_screened_codes": op13_screened_codes,
}

ORACLE_SQL = {
    "op2_recompression": OP2_SQL,
    "op4_spaced_seeds": OP4_SQL,
    "op11_lloyd": OP11_SQL,
    "op12_warc_index": OP12_SQL,
    "op13_screened_codes": OP13_SQL,
}
