"""The same evaluation on question files as they arrive."""
