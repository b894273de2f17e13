"""All queries outside the training-data subpackage, by name, and SQL that gives the same rows."""

from __future__ import annotations

from . import cohort_queries, density_queries, event_queries, fit_queries, inference_queries, metric_queries, model_queries, report_queries, signal_queries, sound_queries, table_queries

FLAGSHIP = "agg3_rates"
MODULES = (event_queries, cohort_queries, density_queries, fit_queries, inference_queries, metric_queries, model_queries, report_queries, signal_queries, sound_queries, table_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
