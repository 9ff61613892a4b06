"""Generic DataFrame operators: clean-up, dedupe, joins, ranks, regression, components, selections."""
