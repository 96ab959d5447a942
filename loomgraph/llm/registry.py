"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from loomgraph.llm.bpe import op2_bpe
from loomgraph.llm.hnsw import op10_ann
from loomgraph.llm.html import op9_html_text
from loomgraph.llm.packing import op8_packing
from loomgraph.llm.pii import op7_pii
from loomgraph.llm.quality import op1_quality_rules
from loomgraph.llm.scoring import op4_lm_scoring
from loomgraph.llm.simhash import op3_simhash
from loomgraph.llm.suffixes import op6_suffix_dedup
from loomgraph.llm.urls import op5_url_filter


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_bpe": op2_bpe,
        "op3_simhash": op3_simhash,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_url_filter": op5_url_filter,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_pii": op7_pii,
        "op8_packing": op8_packing,
        "op9_html_text": op9_html_text,
        "op10_ann": op10_ann,
    }


def oracle_sql() -> dict[str, str]:
    return {}
