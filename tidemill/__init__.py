"""Spark-first engine for incremental, self-checking data pipelines."""
