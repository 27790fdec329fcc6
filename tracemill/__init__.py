"""tracemill: a Spark-first engine for building, scoring and curating step-by-step reasoning data."""
