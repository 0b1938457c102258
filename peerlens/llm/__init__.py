"""Training-data operators: fingerprints, near-duplicates, tokenisation, filters, scoring."""
