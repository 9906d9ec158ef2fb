"""Content QA and reconciliation over Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; vocabularies, rules and
decisions are input tables.  Nothing in the package collects data to the driver.
"""
