"""Functions that are no operators."""
