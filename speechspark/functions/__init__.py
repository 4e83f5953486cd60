"""Column expressions and block primitives shared by the operators."""
