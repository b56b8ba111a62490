"""functions of rectifold."""
