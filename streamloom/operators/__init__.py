"""DataFrame operators: windows, aggregates, joins, log maintenance, metrics, alerts, groups, replication, limits."""
