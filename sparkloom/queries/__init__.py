"""The registered queries of the core and their SQL."""

from sparkloom.queries import catalogue, evaluation, incremental, passages, pipeline, retrieval, service, storing

MODULES = (incremental, retrieval, catalogue, evaluation, passages, service, pipeline, storing)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
