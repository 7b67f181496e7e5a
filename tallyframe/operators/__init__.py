"""Reconciliation as DataFrame operators."""
