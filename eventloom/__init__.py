"""eventloom: event and interval analytics as ordinary Spark DataFrame operations."""
