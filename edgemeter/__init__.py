"""Spark-native analytics for ranked edge lists and expression matrices."""

from edgemeter.schema import CELL_KEYS, KEYS, PAIR

__all__ = ["CELL_KEYS", "KEYS", "PAIR"]
