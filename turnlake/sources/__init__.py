"""Session logs: JSON lines, message tables, and the bindings of the driver's tables."""
