"""The query modules; importing this package registers them all."""

from . import q_buckets, q_checks, q_features, q_more, q_panel, q_prices, q_quality, q_snapshot, q_strategies, q_universe  # noqa: F401
