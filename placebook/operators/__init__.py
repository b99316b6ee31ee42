"""Planning, task runs, normalisation, deduplication and roll-ups."""
