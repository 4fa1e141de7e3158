"""Operators on training text: leaked evaluation items, source files nobody wrote, packing, text quality."""
