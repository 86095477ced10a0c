"""Writers. Results are tables partitioned by their natural keys instead of path strings."""
