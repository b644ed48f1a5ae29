"""strandweave: overlap-based analysis and correction of short sequences on Spark."""

__version__ = "0.1.0"
