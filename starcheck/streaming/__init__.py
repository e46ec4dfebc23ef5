"""The scoring job as a structured stream."""
