"""Queries over the driver's tables, and their SQL."""

from framelake.plans import checked, datasets, frames, functions, life, masks, quality, resampled, roundtrips, shapes, subjects, tables, training, transforms
from framelake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "checked", "datasets", "frames", "functions", "life", "masks", "quality", "resampled", "roundtrips", "shapes", "subjects", "tables", "training", "transforms"]
