"""DataFrame operators: joins, aggregates, windows."""
