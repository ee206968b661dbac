"""Pure functions without Spark."""
