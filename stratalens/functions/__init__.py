"""Part of stratalens."""
