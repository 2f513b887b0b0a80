"""Table-level operators on flows, accounts and indicators."""
