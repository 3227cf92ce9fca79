"""Operators on training text: personal data, garbled text, quoted history, packing, leakage, splitting."""
