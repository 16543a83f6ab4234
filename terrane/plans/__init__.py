"""Compositions of operators: annotation, contrastive and descriptive explanation."""
