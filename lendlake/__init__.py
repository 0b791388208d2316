"""Loan-portfolio analytics on Spark DataFrames.

``sources``    the 14 typed tables, readers and exports
``functions``  column expressions and reusable DataFrame building blocks
``operators``  portfolio queries, look-ups, lifecycle jobs, scoring
``streaming``  payment intake and running collections
``plans``      the catalogue of named queries and their SQL counterparts
"""

__version__ = "0.1.0"
