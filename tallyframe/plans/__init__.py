"""Reconciliations as named queries, with the SQL that checks them."""
