"""Part of the event analytics library."""
