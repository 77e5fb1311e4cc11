"""Spark-native modelling and batch scoring for wide per-entity tables."""

from widecast.spec import FeatureSpec, TableSpec

__all__ = ["FeatureSpec", "TableSpec"]
