"""All registered queries."""

from . import answers, catalog, checks, components, requests, rules, runs, scoring, streams, texts
from .registry import ORACLES, QUERIES, oracles

__all__ = ["ORACLES", "QUERIES", "answers", "catalog", "checks", "components", "oracles", "requests", "rules", "runs", "scoring", "streams", "texts"]
