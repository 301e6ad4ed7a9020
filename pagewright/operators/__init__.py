"""Operators over tokens, regions, labels and cells; importing this registers all."""

from . import aggregates, boosting, features, geometry, images, joins, matrix, model, regions, scans, sequence, sweep  # noqa: F401
