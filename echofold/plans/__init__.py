"""Views over the test tables, and the engine's queries with their SQL."""
