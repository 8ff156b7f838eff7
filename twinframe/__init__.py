"""Near-duplicate media analytics as DataFrame programs."""
