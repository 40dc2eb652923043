"""Weftline: analytics over ordered, semi-structured records, declared on Spark DataFrames."""
