"""Object-centric event-log analytics on Spark."""
