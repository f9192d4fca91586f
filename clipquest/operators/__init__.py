"""DataFrame-to-DataFrame steps of an evaluation."""
