"""DataFrame operators: validation, joins, aggregates, windows, sampling, sets, token sequences."""
