"""Listing intelligence on Spark: chat posts in, a searchable table of second-hand listings out.

Every operator is a function from DataFrames to a DataFrame; nothing in the package owns a session, and no operator
collects rows to the driver.
"""
