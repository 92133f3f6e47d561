"""A ledger derived from the retail test tables, and the same derivation in SQL."""
