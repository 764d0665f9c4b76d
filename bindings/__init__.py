"""Driver queries: every operator bound to the given tables, with the SQL that checks it."""
