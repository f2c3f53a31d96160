"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator;
``registry`` holds the queries that apply them to whole tables.
"""
