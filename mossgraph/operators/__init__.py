"""Operators on DataFrames: read model, longitudinal views, reconciliation, projections, research state, evaluation."""
