"""DataFrame operators: filters, taggers, joins, aggregates, rankings, audits."""
