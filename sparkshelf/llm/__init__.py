"""Training-data operators: quality, secrets, packing, near copies, mixing, licences, toxicity, archives, fingerprints, token counts."""
