"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe import op9_bpe
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .fill_in_middle import OP12_SQL, op12_fill_in_middle
from .fingerprints import op5_fingerprints
from .jaccard_join import OP3_SQL, op3_jaccard_join
from .line_dedup import OP1_SQL, op1_line_dedup
from .lm_scoring import op11_lm_scoring
from .mixing import OP2_SQL, op2_mix_sources
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .suffix_dedup import OP7_SQL, op7_suffix_dedup
from .token_files import op8_token_files
from .toxicity import op10_toxicity
from .whitening import op13_whitening

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_mix_sources, op3_jaccard_join, op4_exact_dedup, op5_fingerprints, op6_substring_dedup, op7_suffix_dedup, op8_token_files, op9_bpe, op10_toxicity, op11_lm_scoring, op12_fill_in_middle, op13_whitening)}
SQL = {"op1_line_dedup": OP1_SQL, "op2_mix_sources": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op12_fill_in_middle": OP12_SQL}
