"""Training-data operators: near duplicates, search, scoring, packing, mixing, encoding and formatting."""
