"""Operators for large training corpora. Nothing else in kgspark imports this subpackage."""
