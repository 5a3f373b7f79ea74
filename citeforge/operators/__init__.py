"""Relational operators: lookups, candidates, ranking, resolution sets, summaries, stores."""
