"""Registered queries on the given tables, and their SQL twins."""

from valuescout.catalogue import gems, listings, models, segments, texts

_FAMILIES = (listings, gems, texts, segments, models)


def queries():
    return {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql():
    return {name: sql.strip() for family in _FAMILIES for name, sql in family.ORACLES.items()}
