"""Operators for the data of language models. Nothing else in the library imports this subpackage."""
