"""Sources of message tables."""
