from .relational import (  # noqa: F401
    AGGREGATES, group, interpolate, join, order, partition, partitioned_join, project, select, semi_reduce, top,
)
