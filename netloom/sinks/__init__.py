"""States that are written: merged versions of keyed tables, exports."""
