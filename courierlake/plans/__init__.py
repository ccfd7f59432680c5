"""The emails relation, guarded SQL and the catalogue of queries."""
