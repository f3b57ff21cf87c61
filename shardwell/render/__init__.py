"""Results as text for a terminal."""
