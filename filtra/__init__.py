"""filtra: filtered, sparse and hybrid retrieval over chunk corpora as Spark jobs."""

__version__ = "0.1.0"
