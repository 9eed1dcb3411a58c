"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op5_bpe
from .centroid_clustering import OP12_SQL, op12_centroid_clustering
from .decontaminate import OP7_SQL, op7_decontaminate
from .jaccard_join import op9_jaccard_join
from .pii import op6_pii
from .quality_classifier import op3_quality_classifier
from .quality_rules import OP1_SQL, op1_quality_rules
from .secrets import op4_secret_scan
from .suffix_dedup import op8_suffix_dedup
from .toxicity import op11_toxicity
from .url_filter import OP10_SQL, op10_url_filter
from .vector_codes import OP13_SQL, op13_vector_codes
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_secret_scan": op4_secret_scan,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_url_filter": op10_url_filter,
    "op11_toxicity": op11_toxicity,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE = {"op1_quality_rules": OP1_SQL, "op2_warc": OP2_SQL, "op7_decontaminate": OP7_SQL, "op10_url_filter": OP10_SQL, "op12_centroid_clustering": OP12_SQL, "op13_vector_codes": OP13_SQL}
