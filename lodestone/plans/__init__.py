"""lodestone plans."""
