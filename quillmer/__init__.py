"""Comparative feature analytics over two cohorts of samples, as Spark plans."""
