"""Operators on DataFrames: normalising, hierarchy, validation, retrieval, coding, evaluation, life cycle."""
