"""functions of the catalogue jobs."""
