"""Queries over the test tables, one or more per operator, each with the SQL it must agree with."""

from catalog import aggregates, columns, joins, modelling, ordered, reports, sets, sources, stars, views
from catalog.common import Query

MODULES = (sources, columns, joins, aggregates, ordered, sets, stars, views, modelling, reports)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for name, entry in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is defined twice")
            found[name] = entry
    return found
