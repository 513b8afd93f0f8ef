"""Column functions: text normalisation, URL extraction, number formats."""
