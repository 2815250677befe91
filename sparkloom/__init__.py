"""Codebase analytics on Spark: scans, rules, graphs, history, scorecards and search as DataFrames."""
