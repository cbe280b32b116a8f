"""Reading raw and stage tables, and writing results."""
