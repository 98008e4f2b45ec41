"""DataFrame operators: regions, overlaps, splits, corpora and labels."""
