"""Registered queries: Spark callables and the SQL that checks them."""
