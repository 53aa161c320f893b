"""The queries of this subpackage by name, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import op1_license, op2_quality_rules, op3_sharding, op4_packing, op5_simhash, op6_langid, op7_chat, op8_mixing, op9_ordinal, op10_embeddings, op11_merkle, op12_toxicity, op13_collocations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license.query,
    "op2_quality_rules": op2_quality_rules.query,
    "op3_sharding": op3_sharding.query,
    "op4_packing": op4_packing.query,
    "op5_simhash_dedup": op5_simhash.query,
    "op6_language_id": op6_langid.query,
    "op7_chat_rotation": op7_chat.query,
    "op8_source_mixing": op8_mixing.query,
    "op9_ordinal_classifier": op9_ordinal.query,
    "op10_embedding_dedup": op10_embeddings.query,
    "op11_merkle_manifest": op11_merkle.query,
    "op12_toxicity": op12_toxicity.query,
    "op13_collocations": op13_collocations.query,
}
SQL: dict[str, str] = {
    "op1_license_scan": op1_license.sql(),
    "op2_quality_rules": op2_quality_rules.sql(),
    "op4_packing": op4_packing.sql(),
    "op7_chat_rotation": op7_chat.sql(),
    "op8_source_mixing": op8_mixing.sql(),
    "op10_embedding_dedup": op10_embeddings.sql(),
    "op11_merkle_manifest": op11_merkle.sql(),
    "op13_collocations": op13_collocations.sql(),
}
