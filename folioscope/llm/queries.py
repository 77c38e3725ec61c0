"""The queries of the corpus operators, one an operator, and their SQL where SQL can express them."""

from .html_extract import op8_html
from .lm import op3_lm
from .mixing import OP4_SQL, op4_mixing
from .neardup_vectors import op2_vector_neardup
from .packing import op6_packing
from .quality import op1_quality
from .simhash import op7_simhash
from .token_files import op9_token_files
from .topk import OP5_SQL, op5_topk
from .toxicity import op10_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_vector_neardup": op2_vector_neardup,
    "op3_lm": op3_lm,
    "op4_mixing": op4_mixing,
    "op5_topk": op5_topk,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_html": op8_html,
    "op9_token_files": op9_token_files,
    "op10_toxicity": op10_toxicity,
}

SQL = {
    "op4_mixing": OP4_SQL,
    "op5_topk": OP5_SQL,
}
