"""Part of the lumora package."""
