"""All queries over the test tables; importing the modules registers them."""

from tidemark.plans import answers, decided, evidence, files, linked, measures, offers, packages, picked, queries, rulings, screens, seconds, talks  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
