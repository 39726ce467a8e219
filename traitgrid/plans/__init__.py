"""Registered query plans over the driver's test tables (see FIXTURES.md §2)."""
