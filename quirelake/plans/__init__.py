"""plans of the catalogue jobs."""
