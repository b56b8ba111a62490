"""plans of rectifold."""
