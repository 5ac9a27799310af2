"""Whole plans: the queries that the driver runs, and the SQL they are held against."""
