"""Column functions: identifiers and behavioural features."""
