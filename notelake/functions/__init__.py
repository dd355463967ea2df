"""Column functions: string and array expressions without state."""
