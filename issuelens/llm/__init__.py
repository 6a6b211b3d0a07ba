"""Training-data operators: deduplication, mixing, filtering, decontamination, privacy, language.

Nothing else in the library imports this package.
"""
