"""operators of the catalogue jobs."""
