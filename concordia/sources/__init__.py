"""Where catalogs, tables, change events and settings come from, and where state goes."""
