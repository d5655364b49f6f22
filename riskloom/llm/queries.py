"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import alignment, chat, clusters, decontaminate, fingerprints, licenses, mixing, near_dedup, passages, quality, secrets, toxicity, url_filter

MODULES = (fingerprints, quality, passages, secrets, licenses, chat, near_dedup, url_filter, mixing, decontaminate, alignment, clusters, toxicity)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
