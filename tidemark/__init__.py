"""Procurement-notice intelligence as DataFrame-to-DataFrame operators on Spark."""
