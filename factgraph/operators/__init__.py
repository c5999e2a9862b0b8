"""One DataFrame operator for each question asked of the facts."""
