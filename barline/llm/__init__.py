"""Training-data operators (deduplication, mixing, filtering, sharding) on Spark."""
