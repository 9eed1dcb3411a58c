"""Driver-side query plans and the registry of queries."""
