"""Training-data operators: page text, URL verdicts, quality, duplicates, contamination, archives, mixes."""
