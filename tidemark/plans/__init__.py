"""Plan shaping: skew-safe ordered work, composite jobs."""
