"""Operators for preparing language-model training data. Nothing else in kinloom imports this subpackage."""
