"""crowdtape: crowd-signal analytics as PySpark DataFrame, SQL and streaming operators."""

__version__ = "0.1.0"
