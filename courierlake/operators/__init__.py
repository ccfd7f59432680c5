"""Query operators over the emails table."""
