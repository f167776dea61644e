"""Named queries of the training-data operators and, where SQL can express them, their SQL counterparts."""

from __future__ import annotations

from .context_mixing import op3_context_mixing
from .decontaminate import op6_decontaminate
from .hamming_search import op4_hamming_search
from .language_id import op7_language_id
from .license_scan import op1_license_scan
from .quality_nbsvm import op8_quality_nbsvm
from .secret_crf import op2_secret_crf
from .shingle_join import op5_shingle_join
from .source_mix import op10_source_mix
from .spectral_whitening import op11_spectral_whitening
from .spelling_trie import OP13_SQL, op13_spelling_variants
from .token_counts import op9_token_counts
from .url_rules import OP12_SQL, op12_url_rules

QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_secret_crf, op3_context_mixing, op4_hamming_search, op5_shingle_join, op6_decontaminate, op7_language_id, op8_quality_nbsvm, op9_token_counts, op10_source_mix,
    op11_spectral_whitening, op12_url_rules, op13_spelling_variants,
)}
ORACLES: dict[str, str] = {"op12_url_rules": OP12_SQL, "op13_spelling_variants": OP13_SQL}
