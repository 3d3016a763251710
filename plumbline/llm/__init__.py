"""Training-data operators over text corpora: scoring, scanning, joining, packing and sharding.

Nothing else in the library imports this subpackage; it may be deleted as a whole.
"""
