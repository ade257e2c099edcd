"""All queries for the surveyed operators; importing the modules registers them."""

from palimpsest.plans import align, editions, links, more, relational, rules, search, sources, text  # noqa: F401
from palimpsest.plans.registry import IDS, QUERIES, SQL  # noqa: F401
