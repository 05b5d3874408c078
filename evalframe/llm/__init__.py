"""Training-data operators: dedup, sharding, extraction, filtering, mixing, packing."""
