"""Spark-native analytics over runtime traces, sampled stacks and heap graphs."""
