"""Training-data operators: de-duplication, filtering, packing and archives.

Nothing else in the library imports this subpackage.
"""
