"""All checked queries; importing this package registers them."""

from . import bars, factors, live, metrics, portfolios, programs, round_trips
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "bars", "factors", "live", "metrics", "portfolios", "programs", "round_trips"]
