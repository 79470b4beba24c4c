"""Column functions with SPARQL 1.1 semantics."""
