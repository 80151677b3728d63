"""Spark-native frame, time-series and corpus analytics."""
