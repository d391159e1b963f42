"""DataFrame operators: filters, joins, aggregates, ordered and ranking operators, encoders."""
