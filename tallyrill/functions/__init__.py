"""Column expressions: field access, predicates, buckets and dates."""
