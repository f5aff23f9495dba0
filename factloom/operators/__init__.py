"""operators of factloom."""
