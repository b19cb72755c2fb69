"""Readers: market tables, ledgers and pages."""
