"""The llm queries and the SQL of those that SQL can express."""

from __future__ import annotations

from jadwal.llm.ann import op9_nearest
from jadwal.llm.decontaminate import OP1_SQL, op1_decontaminate
from jadwal.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from jadwal.llm.jaccard_join import OP3_SQL, OP13_SQL, op13_jaccard_join
from jadwal.llm.kd_clustering import OP12_SQL, op12_clusters
from jadwal.llm.license_scan import op6_license_scan
from jadwal.llm.near_dedup import op3_near_dedup
from jadwal.llm.packing import op4_packing
from jadwal.llm.pii import op8_pii
from jadwal.llm.sharding import op7_sharding
from jadwal.llm.suffix_dedup import op5_suffix_dedup
from jadwal.llm.toxicity import op2_toxicity
from jadwal.llm.url_filter import OP10_SQL, op10_url_filter

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_near_dedup": op3_near_dedup,
    "op4_packing": op4_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_nearest": op9_nearest,
    "op10_url_filter": op10_url_filter,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_clusters": op12_clusters,
    "op13_jaccard_join": op13_jaccard_join,
}
ORACLE = {
    "op1_decontaminate": OP1_SQL,
    "op3_near_dedup": OP3_SQL,
    "op10_url_filter": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_clusters": OP12_SQL,
    "op13_jaccard_join": OP13_SQL,
}
