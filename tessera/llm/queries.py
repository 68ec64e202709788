"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .jaccard_join import op3_jaccard_join
from .line_templates import op5_line_templates
from .mixing import op9_mixing
from .neighbours import op6_neighbours
from .oracles import ORACLES
from .packing import op10_packing
from .pii import op2_pii
from .simhash import op4_simhash
from .substrings import op1_substrings
from .toxicity import op8_toxicity
from .url_filters import op7_url_filters

QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_pii": op2_pii,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_simhash": op4_simhash,
    "op5_line_templates": op5_line_templates,
    "op6_neighbours": op6_neighbours,
    "op7_url_filters": op7_url_filters,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
}

__all__ = ["ORACLES", "QUERIES"]
