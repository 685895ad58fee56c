"""sources of the catalogue jobs."""
