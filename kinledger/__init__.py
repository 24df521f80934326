"""Record linkage, register ingest and evidence assessment as Spark plans."""

__version__ = "0.1.0"
