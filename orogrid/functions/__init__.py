"""Column functions: geometry, predicates and spectral arithmetic. All stay inside Catalyst expressions."""
