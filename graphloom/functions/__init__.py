"""Values, predicates and aggregates."""
