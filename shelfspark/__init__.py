"""Circulation analytics on Spark: lending, reservations, readers and reports
expressed as DataFrame jobs over tables of any size."""

__version__ = "0.1.0"
