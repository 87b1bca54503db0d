"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from dapple.llm import importance, licenses, negatives, rollups
from dapple.llm.annsearch import op9_anisotropic_search
from dapple.llm.decontam import op8_benchmark_leaks
from dapple.llm.importance import op13_importance_resampling
from dapple.llm.licenses import op3_licence_digests
from dapple.llm.mixing import op5_pareto_mix
from dapple.llm.neardup import op7_weighted_minhash
from dapple.llm.negatives import op11_hard_negatives
from dapple.llm.pii import op1_bootstrapped_pii
from dapple.llm.rollups import op6_token_rollups
from dapple.llm.suffixtree import op2_suffix_tree_scores
from dapple.llm.tokenbin import op4_token_frames
from dapple.llm.toxicity import op10_toxicity
from dapple.llm.triebpe import op12_trie_bpe

QUERIES = {f.__name__: f for f in (op1_bootstrapped_pii, op2_suffix_tree_scores, op3_licence_digests, op4_token_frames, op5_pareto_mix, op6_token_rollups, op7_weighted_minhash, op8_benchmark_leaks, op9_anisotropic_search, op10_toxicity, op11_hard_negatives, op12_trie_bpe, op13_importance_resampling)}
ORACLE_SQL: dict[str, str] = {"op3_licence_digests": licenses.ORACLE, "op6_token_rollups": rollups.ORACLE, "op11_hard_negatives": negatives.ORACLE, "op13_importance_resampling": importance.ORACLE}
