"""One query per operator, each with the SQL it is checked against."""

from tallyweave.plans.catalog import (  # noqa: F401
    aggregates,
    filters,
    joins,
    judging,
    mappings,
    ordering,
    reports,
    scans,
    streams,
    token_lists,
    user_functions,
)
from tallyweave.plans.catalog.base import ORACLES, QUERIES  # noqa: F401
