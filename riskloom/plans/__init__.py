"""Operators combined into complete jobs, and the registered queries."""
