"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator is a function from DataFrames to DataFrames; the
``opN_<name>`` queries in :mod:`.queries` apply them with production parameters.
"""
