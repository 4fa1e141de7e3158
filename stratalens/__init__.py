"""Stratalens: software-architecture analytics and data upkeep on Spark tables."""
