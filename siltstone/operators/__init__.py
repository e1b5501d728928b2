"""Table-level operators: joins, aggregates, windows, dedup, retention."""
