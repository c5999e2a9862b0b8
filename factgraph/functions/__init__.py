"""Column functions: name and path predicates, severities, labels, namespaces."""
