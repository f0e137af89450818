"""Operators for preparing large text corpora, their queries and SQL counterparts.

Nothing outside this package imports it. Input columns are found by name, null texts count as empty, and
every operator accepts empty tables and extra columns.
"""
