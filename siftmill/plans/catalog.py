"""All registered queries of the engine: name -> (query, DuckDB SQL or None)."""

from . import corpus_plans, guard_plans, metric_plans, report_plans, schema_plans, surface_plans, text_plans

QUERIES: dict = {**text_plans.QUERIES, **metric_plans.QUERIES, **corpus_plans.QUERIES, **surface_plans.QUERIES, **guard_plans.QUERIES, **schema_plans.QUERIES, **report_plans.QUERIES}
