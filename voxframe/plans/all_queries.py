"""Imports every plan module so that its queries are registered."""

from voxframe.plans.registry import ORACLES, QUERIES  # noqa: F401
from voxframe.plans import augmented, files, keys, scores, series, spatial, voxels  # noqa: F401
