"""Operators for preparing large language-model training data.

Nothing outside this package imports it.  ``entries`` holds the registered
queries and their SQL; every other module holds one operator.
"""
