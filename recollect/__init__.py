"""Part of the episodic-memory engine."""
