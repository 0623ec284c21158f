"""Physical operators over candidate, record and document tables."""
