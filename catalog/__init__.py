"""Registered queries: the library's operators over the given tables, with SQL to check them."""
