"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from corpusmill.llm.chroma import op6_chroma_prints
from corpusmill.llm.edits import op7_edit_counts
from corpusmill.llm.mixing import op10_pivotal_mix
from corpusmill.llm.ngramjoin import op9_ngram_jaccard
from corpusmill.llm.packing import op5_best_fit_packing
from corpusmill.llm.pii import op1_pii_bootstrap
from corpusmill.llm.secrets import op3_secret_grammar
from corpusmill.llm.search import op8_block_max_search
from corpusmill.llm.tokenfiles import op2_token_files
from corpusmill.llm.toxicity import op4_toxic_segments

QUERIES = {
    "op1_pii_bootstrap": op1_pii_bootstrap,
    "op2_token_files": op2_token_files,
    "op3_secret_grammar": op3_secret_grammar,
    "op4_toxic_segments": op4_toxic_segments,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_chroma_prints": op6_chroma_prints,
    "op7_edit_counts": op7_edit_counts,
    "op8_block_max_search": op8_block_max_search,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_pivotal_mix": op10_pivotal_mix,
}

#: DuckDB SQL where SQL can express the whole result.
ORACLES: dict[str, str] = {}
