"""Training-data operators: packing, repeats, secrets, near-duplicates, language, quality, text extraction."""
