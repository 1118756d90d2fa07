"""Stream and table analytics on PySpark: relational operators, event-time windows, sources and sinks."""
