"""The queries of this subpackage and what DuckDB is to find for them."""

from __future__ import annotations

from .jaccard import OP10_SQL, op10_jaccard_join
from .knn import OP5_SQL, op5_voronoi_top_k
from .mixing import OP9_SQL, op9_fair_mixing
from .packing import op8_packing
from .pages import op6_html_text
from .pii import op4_pii
from .ppm import op2_ppm_scores
from .quality import op1_quality_rules
from .substrings import op3_substring_dedup
from .tokens import op7_token_counts

QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_ppm_scores, op3_substring_dedup, op4_pii, op5_voronoi_top_k, op6_html_text, op7_token_counts, op8_packing, op9_fair_mixing, op10_jaccard_join)
}
ORACLE_SQL = {"op5_voronoi_top_k": OP5_SQL, "op9_fair_mixing": OP9_SQL, "op10_jaccard_join": OP10_SQL}
