"""sources of rectifold."""
