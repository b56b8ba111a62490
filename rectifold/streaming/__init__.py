"""streaming of rectifold."""
