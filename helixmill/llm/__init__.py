"""Operators for training data: repeated spans, near-duplicates, overlaps, splits, samples, mixtures, counts, token ids and content scores."""
