"""cueloom: timed-text and speech-quality analytics as Spark DataFrame jobs."""
