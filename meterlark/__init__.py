"""Usage analytics for language-model telemetry on Spark."""
