"""Evidence retrieval, verification and gap analysis as Spark DataFrame jobs."""

__version__ = "0.2.0"
