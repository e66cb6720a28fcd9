"""Spark-native analytics over archives of AVI and ASF/WMV video files."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
