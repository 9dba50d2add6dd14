"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontaminate import op2_decontaminate
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .html_extract import op3_html_extract
from .license_scan import OP8_SQL, op8_license_scan
from .line_dedup import OP9_SQL, op9_line_dedup
from .near_dedup import OP6_SQL, op6_near_dedup
from .packing import op4_best_fit_packing
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .token_output import op7_token_ids
from .toxicity import op10_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_html_extract": op3_html_extract,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_token_ids": op7_token_ids,
    "op8_license_scan": op8_license_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
}
SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op6_near_dedup": OP6_SQL,
    "op8_license_scan": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
}
