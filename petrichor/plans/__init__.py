"""Named queries over the driver tables and their SQL twins."""

from . import (q_calibration, q_covariates, q_grid, q_manifest, q_metrics, q_sampling, q_scalars, q_slots, q_sources,  # noqa: F401
               q_stats, q_streaming, q_targets, q_validation)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
