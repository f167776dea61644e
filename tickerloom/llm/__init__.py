"""Training-data operators: scans, scoring, search, joins, mixing."""
