"""Training-data operators: deduplication, mixing, fingerprints, tokenisation, toxicity."""
