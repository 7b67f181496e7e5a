"""Data reconciliation and corpus building on Spark DataFrames."""
