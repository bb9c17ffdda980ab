"""PySpark-native analytics for tracks, poses and run metrics."""
