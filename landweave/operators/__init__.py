"""Operators over DataFrames; none of them reads or writes a database."""
