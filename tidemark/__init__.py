"""Spark-native market feature engine."""
