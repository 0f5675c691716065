"""Event-based cohort studies and label measurement-error analysis on PySpark."""

__version__ = "0.1.0"
