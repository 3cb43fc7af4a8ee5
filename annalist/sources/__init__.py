"""Ledger tables: views over the driver's tables, durable tables, export files, the directory layout."""
