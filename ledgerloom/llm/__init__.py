"""Training-data operators: media, secrets, near duplicates, tokens, quality, toxicity, archives, packing, pseudonyms, search, page texts, whitening."""
