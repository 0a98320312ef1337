"""Training-data operators: filtering, de-duplication, formatting, packing, search, sharding."""
