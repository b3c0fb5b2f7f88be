"""Every operator as a query over the stored tables, with its SQL where SQL can express it."""

from slackline.queries import domain, learning, relational, upkeep  # noqa: F401  they register themselves
from slackline.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
