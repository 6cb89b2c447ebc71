"""The training-data queries and the SQL that checks them."""

from __future__ import annotations

from . import oracles
from .compression_quality import op10_compression_quality
from .deleted_interpolation import op7_deleted_interpolation
from .disclosure import op1_disclosure
from .language_evidence import op5_language_evidence
from .phrase_fingerprint import op2_phrase_fingerprint
from .sentencepiece_codec import op6_sentencepiece
from .simhash_pivots import op3_simhash_pivots
from .string_tiling import op8_string_tiling
from .suffix_dedup import op9_suffix_dedup
from .warc_revisit import op4_warc_revisit

QUERIES = {
    f.__name__: f
    for f in (
        op1_disclosure,
        op2_phrase_fingerprint,
        op3_simhash_pivots,
        op4_warc_revisit,
        op5_language_evidence,
        op6_sentencepiece,
        op7_deleted_interpolation,
        op8_string_tiling,
        op9_suffix_dedup,
        op10_compression_quality,
    )
}

#: What SQL can express; the others are held to plain Python in tests/llm.
ORACLES = {
    "op1_disclosure": oracles.DISCLOSURE,
    "op3_simhash_pivots": oracles.SIMHASH,
    "op4_warc_revisit": oracles.WARC,
    "op8_string_tiling": oracles.TILING,
    "op9_suffix_dedup": oracles.REPEATS,
}
