"""Query classification and the composed searches that it selects."""
