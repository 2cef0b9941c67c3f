"""The queries of this subpackage, and their SQL where SQL can express them."""

from .lattice import ORACLE as LATTICE_SQL
from .lattice import op13_lattice_dedup
from .language import op9_hmm_scores
from .leaks import op10_decontamination
from .licences import op5_licences
from .lines import op7_line_dedup
from .mixing import ORACLE as MIXING_SQL
from .mixing import op8_mixing
from .near import op1_ngram_jaccard
from .negatives import ORACLE as NEGATIVES_SQL
from .negatives import op11_hard_negatives
from .spelling import op12_spelling_variants
from .substrings import op2_suffix_dedup
from .vectors import ORACLE as TOPK_SQL
from .vectors import op4_topk
from .tokens import op6_token_counts
from .toxicity import op3_toxicity

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_topk": op4_topk,
    "op5_licences": op5_licences,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_hmm_scores": op9_hmm_scores,
    "op10_decontamination": op10_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lattice_dedup": op13_lattice_dedup,
}
ORACLE_SQL = {"op4_topk": TOPK_SQL, "op8_mixing": MIXING_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op13_lattice_dedup": LATTICE_SQL}
