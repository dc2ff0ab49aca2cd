"""Jobs that chain operators end to end."""
