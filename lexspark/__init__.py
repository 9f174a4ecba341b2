"""lexspark: retrieval, answer auditing and corpus preparation for statute text on Spark."""
