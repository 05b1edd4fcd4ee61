"""Tables of fixed values."""
