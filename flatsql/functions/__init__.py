"""Value semantics and scalar functions as Column expressions."""
