"""Registered queries of the document-organisation operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import catalogue_flow, catalogue_graph, catalogue_more, catalogue_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**catalogue_text.QUERIES, **catalogue_graph.QUERIES, **catalogue_flow.QUERIES, **catalogue_more.QUERIES}
ORACLES: dict[str, str] = {**catalogue_text.ORACLES, **catalogue_graph.ORACLES, **catalogue_flow.ORACLES, **catalogue_more.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cleaned and stripped of template lines, as what is embedded for each note."""
    return QUERIES["processed_notes"](spark, sf_dir)
