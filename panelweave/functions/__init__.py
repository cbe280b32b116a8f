"""Column-level helpers: null rules, text and code handling, numeric helpers."""
