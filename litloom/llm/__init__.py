"""Training-data operators: fingerprints, packing, de-duplication, mixing, scoring, extraction.

Each module holds one operator; ``entry`` maps query names to them.  Nothing else
in the library imports this subpackage.
"""
