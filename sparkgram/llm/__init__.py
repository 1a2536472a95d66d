"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Every operator takes DataFrames and
returns DataFrames; ``queries.py`` holds the thin queries registered with the
driver and ``oracles.py`` the SQL twins, where SQL can express one.
"""
