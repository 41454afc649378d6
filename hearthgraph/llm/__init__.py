"""Training-data operators: extraction, counts, formatting, duplicates, packing, search, tokenization, quality."""
