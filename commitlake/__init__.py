"""commitlake package."""
