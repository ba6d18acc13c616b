"""Training-data operators: ten corpus jobs that stand apart from the rest of the library."""
