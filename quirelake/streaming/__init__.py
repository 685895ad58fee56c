"""streaming of the catalogue jobs."""
