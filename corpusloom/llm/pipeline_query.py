"""Registers the corpus pipeline as a query."""

import corpus_pipeline

QUERIES = {"pipeline": corpus_pipeline.run}
ORACLES = {"pipeline": corpus_pipeline.ORACLE_SQL}
