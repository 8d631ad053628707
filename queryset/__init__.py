"""All registered queries, by the keys of the operator inventory."""

from . import bars, news, plans, quotes, research, runs, streams
from .core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "bars", "news", "plans", "quotes", "research", "runs", "streams"]
