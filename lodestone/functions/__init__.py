"""lodestone functions."""
