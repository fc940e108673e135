"""Files the jobs write."""
