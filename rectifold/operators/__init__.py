"""operators of rectifold."""
