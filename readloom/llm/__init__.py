"""Training-data operators: extraction, deduplication, filtering, mixing and encoding of text corpora."""
