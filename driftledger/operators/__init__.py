"""DataFrame-to-DataFrame operators over the logical tables."""
