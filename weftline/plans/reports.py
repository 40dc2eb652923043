"""Text reports of the study: small results of the registered queries, laid out as tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.plans import files, metrics, sequence
from weftline.sources.sinks import report


def _joined(*parts: str) -> str:
    return "\n".join(parts)


def metrics_report(spark: SparkSession, folder: str) -> str:
    """Descriptive statistics, features, thresholds and tests of the metrics of workflows."""
    ranks = metrics.mann_whitney_cliffs(spark, folder).where("effect <> 'negligible'").select("metric", "group_1", "group_2", "delta", "effect")
    return _joined(
        report("DESCRIPTIVE STATISTICS", metrics.descriptives_scoped(spark, folder).orderBy("language", "metric")),
        report("FEATURES", metrics.binary_stats_scoped(spark, folder).orderBy("language", "feature")),
        report("PERCENTILE THRESHOLDS", metrics.percentile_cuts(spark, folder).orderBy("metric")),
        report("DIFFERENCES BETWEEN LANGUAGES", metrics.kruskal_wallis(spark, folder).orderBy("metric")),
        report("EFFECTS BETWEEN PAIRS OF LANGUAGES", ranks.orderBy("metric", "group_1", "group_2")),
    )


def patterns_report(spark: SparkSession, folder: str) -> str:
    """Summaries per language, common sequences, transitions and absences, and the number of notable tests."""
    return _joined(
        report("SUMMARY", sequence.global_summary(spark, folder)),
        report("LANGUAGES", sequence.language_summary(spark, folder).orderBy("language")),
        report("TOP SEQUENCES", sequence.top_sequences(spark, folder).orderBy("language", "rank")),
        report("TRANSITIONS", sequence.step_transitions(spark, folder).orderBy("language", F.desc("count"), "from_step", "to_step")),
        report("ABSENCE OF CONSTRUCTS", sequence.absence_pivot(spark, folder).orderBy("pattern")),
        report("TESTS", metrics.notable_tests(spark, folder).orderBy("kind")),
    )


def sample_report(spark: SparkSession, folder: str) -> str:
    """How the sample is allocated to strata, and what it holds per language."""
    return _joined(
        report("ALLOCATION", files.stratified_allocation(spark, folder).orderBy("language", "stratum")),
        report("SAMPLING FRAME", files.sample_summary(spark, folder).orderBy("language")),
    )


def compliance_report(spark: SparkSession, folder: str) -> str:
    """The rules by risk, and the distribution of scores."""
    scores = files.rule_scores(spark, folder).groupBy("status").agg(F.count("*").alias("files"), F.round(F.avg("compliance_score"), 4).alias("mean_score"), F.round(F.avg("total_violations"), 2).alias("mean_violations"))
    return _joined(report("RULES BY RISK", files.rule_ranking(spark, folder).orderBy("rank")), report("SCORES", scores.orderBy("status")))
