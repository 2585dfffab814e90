"""Readers: tables, packages, markup."""
