"""Bylines: news-evidence analytics as Spark jobs, keyed by run."""
