"""What is decided before a plan runs: suites, contexts, keys, declarations, predicates."""
