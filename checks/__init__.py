"""Check queries: every operator run on the given tables, with the SQL that must give the same rows."""
