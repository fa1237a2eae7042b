"""Column functions: everything here maps one row to one value."""
