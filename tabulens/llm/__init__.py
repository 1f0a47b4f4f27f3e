"""Operators for preparing training data; nothing outside this package imports it.

Every operator takes the names of its columns and selects only those, so further columns, also
ones named like an internal column, never clash. Rows whose id is NULL cannot be named in a result
and are left out; a NULL text counts as the empty text.
"""
