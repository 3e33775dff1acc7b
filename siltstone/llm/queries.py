"""The subpackage's registered queries, one per operator."""

from __future__ import annotations

from .decontamination import op1_decontamination
from .hnsw import op8_embedding_dedup
from .licenses import op2_license_scan
from .packing import op4_packing
from .partenum import op6_jaccard_join
from .rollups import op3_token_rollup
from .sstable import op5_token_sst
from .suffixes import op10_suffix_dedup
from .toxicity import op9_toxicity
from .urls import op7_url_filter
from .urls import oracle as url_oracle

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_token_rollup": op3_token_rollup,
    "op4_packing": op4_packing,
    "op5_token_sst": op5_token_sst,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_url_filter": op7_url_filter,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLES: dict[str, str] = {"op7_url_filter": url_oracle()}
