"""Change analytics on Spark: two snapshots in, ranked and explained differences out."""
