"""Table-in, table-out steps of the fleet analytics."""
