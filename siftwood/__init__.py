"""Siftwood: a Spark-first search, record-reconciliation and corpus engine."""
