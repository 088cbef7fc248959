"""Support-message analytics as Spark plans."""
