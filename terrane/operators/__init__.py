"""Orderings, neighbour joins, tree partitions and conditioning rules over point tables."""
