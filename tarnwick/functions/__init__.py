"""Part of the tarnwick engine."""
