"""tidemark: event-clock and time-series analytics as PySpark DataFrame programs."""
