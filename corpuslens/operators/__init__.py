"""Spark operators: chunks, BM25, evidence, model calls, pages, metrics, pairs, rules."""
