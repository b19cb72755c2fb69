"""Market screening, ledger reports and page extraction as Spark DataFrame jobs.

Every operator is a plain function from DataFrames to a DataFrame, built from
native Spark expressions, so Catalyst plans and distributes the work.
"""
