"""DataFrame operators, grouped by the stage they serve."""
