"""Sources, tables and logs."""
