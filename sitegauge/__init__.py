"""Spark-native website compliance analytics: page signals, rules, duplicates, lifecycle, scores, reports."""

from sitegauge.params import Params

__all__ = ["Params"]
