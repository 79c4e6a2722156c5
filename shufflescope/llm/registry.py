"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chunk_dedup import op4_substring_dedup
from .decontamination import OP6_SQL, op6_decontamination
from .jaccard_join import OP8_SQL, op8_jaccard_join
from .neighbours import op7_nearest_neighbours
from .packing import op10_packing
from .repeated_bytes import op9_suffix_dedup
from .secret_scan import op3_secret_scan
from .token_counts import op5_token_counts
from .token_files import op2_token_files
from .toxicity import op1_toxicity

_ALL = (op1_toxicity, op2_token_files, op3_secret_scan, op4_substring_dedup, op5_token_counts, op6_decontamination, op7_nearest_neighbours, op8_jaccard_join, op9_suffix_dedup, op10_packing)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op6_decontamination": OP6_SQL, "op8_jaccard_join": OP8_SQL}
