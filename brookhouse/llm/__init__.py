"""Training-data operators: cleaning, language, duplicates, extraction, mixing, toxicity, packing."""
