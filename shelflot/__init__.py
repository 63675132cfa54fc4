"""shelflot: lot-tracked, perishable retail stock analytics as PySpark DataFrames."""

__version__ = "0.1.0"
