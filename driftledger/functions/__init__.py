"""Column-level functions: text, object extraction, type maps, naming, JSON contracts."""
