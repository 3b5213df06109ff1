"""User-facing queries composed from the operators."""
