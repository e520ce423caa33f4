"""Operators combined into the steps a steward runs."""
