"""Column functions: pure expressions that stay inside code generation."""
