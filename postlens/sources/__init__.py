"""Reading and writing of the post, entity and lookup tables."""
