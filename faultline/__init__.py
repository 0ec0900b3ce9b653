"""Incident analytics as Spark jobs: evidence readers, relational operators, inference and budgets over DataFrames."""
