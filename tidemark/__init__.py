"""Event lakehouse and training-corpus operators written as DataFrame transformations."""
