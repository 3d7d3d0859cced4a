"""Imports every query module once."""

from phenospark.plans import q_models, q_profile, q_rules, q_stats, q_tables, q_texture, q_voxel  # noqa: F401
