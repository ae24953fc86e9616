"""Part of the posting inventory engine."""
