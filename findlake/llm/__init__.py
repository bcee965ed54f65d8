"""Training-data operators: near-duplicate, contamination, quality and packing jobs over document tables."""
