"""Ready-made plans: the reference resolution queries and their SQL."""
