"""Reports and maintenance jobs: operators composed over the tables."""
