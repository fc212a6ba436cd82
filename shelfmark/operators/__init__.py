"""DataFrame operators: joins, aggregates, policies and reports over assets."""
