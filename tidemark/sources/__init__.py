"""Sources: the given tables, and domain inputs derived from them."""
