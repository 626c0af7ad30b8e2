"""Air-quality exposure jobs as DataFrame, SQL and Structured Streaming code."""
