"""Training-data operators.  Nothing outside this package (and the entry points) imports it."""
