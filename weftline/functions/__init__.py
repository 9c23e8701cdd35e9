"""Scalar functions: Column builders, and Arrow-batched UDFs where Catalyst has no expression."""
