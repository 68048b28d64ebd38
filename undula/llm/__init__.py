"""Training-data operators: dedup, filtering, scanning, packing and token output.

Nothing else in the library imports this subpackage.
"""
