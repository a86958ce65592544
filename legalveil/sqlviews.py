"""The engine's tables for users of SQL: temporary views over one analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .plans.pseudonymize import analyze, render


def register(spark: SparkSession, docs: DataFrame, config: Config | None = None, **options) -> None:
    """Views docs, candidates, decisions, entities, residuals and reports of docs (doc_id, text)."""
    analysis = analyze(docs, config, **options)
    reports = render(analysis, config, **options)
    docs.createOrReplaceTempView("docs")
    for name in ("candidates", "decisions", "entities"):
        analysis.select("doc_id", F.inline(name)).createOrReplaceTempView(name)
    reports.select("doc_id", F.inline("residuals")).createOrReplaceTempView("residuals")
    reports.drop("residuals", "entities", "decisions").createOrReplaceTempView("reports")
