"""Event contracts, parsing, tables and adapters."""
