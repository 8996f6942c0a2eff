"""Index, search, sharding and codec operators."""
