"""Named pipelines and serving queries."""
