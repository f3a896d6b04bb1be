"""Column functions: times, index names, JSON documents and request bodies."""
