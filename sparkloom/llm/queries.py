"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from sparkloom.llm import best_fit, clustering, collocations, exact_dedup, licenses, mixing, ngram_join, order_minhash, packing, sharding, sstable, suffix_dedup, toxicity

MODULES = (ngram_join, exact_dedup, licenses, mixing, suffix_dedup, sstable, toxicity, order_minhash, sharding, packing, best_fit, collocations, clustering)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    out = {k: v for m in MODULES for k, v in m.ORACLES.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
