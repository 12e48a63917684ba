"""Training-data operators: extraction, quality, de-duplication, mixing and sharding."""
