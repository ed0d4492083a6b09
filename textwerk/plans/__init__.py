from . import metric_queries, pipeline_queries, set_queries, text_queries

REGISTRIES = (text_queries.q, set_queries.q, metric_queries.q, pipeline_queries.q)


def queries():
    return {k: v for r in REGISTRIES for k, v in r.queries.items()}


def oracle_sql():
    return {k: v for r in REGISTRIES for k, v in r.sql.items()}
