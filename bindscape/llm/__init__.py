"""Training-data operators: sharding, near-duplicate detection, token counts,
web archives, toxicity, quality, decontamination, fingerprints and mixing.

Nothing else in the library imports this subpackage."""
