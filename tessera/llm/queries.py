"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm.line_dedup import ORACLE as sites_sql
from tessera.llm.line_dedup import op6_site_spread
from tessera.llm.line_rules import ORACLE as rules_sql
from tessera.llm.line_rules import op5_line_frequency
from tessera.llm.minhash_join import ORACLE as near_sql
from tessera.llm.minhash_join import op7_minhash_join
from tessera.llm.mixing import op9_pivotal_mix
from tessera.llm.nbest_pieces import op1_nbest_pieces
from tessera.llm.quality_knn import op10_quality_knn
from tessera.llm.secret_index import _oracle as secrets_sql
from tessera.llm.secret_index import op4_trigram_secrets
from tessera.llm.token_orc import op3_token_orc
from tessera.llm.toxicity import op2_toxicity
from tessera.llm.webp import op8_webp_pixels

QUERIES = {
    "op1_nbest_pieces": op1_nbest_pieces,
    "op2_toxicity": op2_toxicity,
    "op3_token_orc": op3_token_orc,
    "op4_trigram_secrets": op4_trigram_secrets,
    "op5_line_frequency": op5_line_frequency,
    "op6_site_spread": op6_site_spread,
    "op7_minhash_join": op7_minhash_join,
    "op8_webp_pixels": op8_webp_pixels,
    "op9_pivotal_mix": op9_pivotal_mix,
    "op10_quality_knn": op10_quality_knn,
}

ORACLE_SQL: dict[str, str] = {"op7_minhash_join": near_sql, "op5_line_frequency": rules_sql, "op4_trigram_secrets": secrets_sql(), "op6_site_spread": sites_sql}
