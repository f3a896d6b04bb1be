"""tidemark: time-tiered event tables on Spark."""
