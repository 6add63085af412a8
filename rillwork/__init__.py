"""rillwork: incremental analytics on Spark DataFrames.

``operators`` has the collections and their batch plans, ``sources`` the change
logs, ``functions`` the scalar functions and the formula language, ``plans`` the
dependency graph and the delta rules, ``streaming`` the epoch runner.
"""
