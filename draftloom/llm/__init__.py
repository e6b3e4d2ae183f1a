"""Operators for text and model-training data; nothing else in the library imports this subpackage."""
