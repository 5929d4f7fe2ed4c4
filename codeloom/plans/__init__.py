"""Plans of the code-graph engine."""
