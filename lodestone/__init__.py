"""Knowledge analytics over multi-tenant text corpora, expressed as Spark jobs."""

__version__ = "0.1.0"
