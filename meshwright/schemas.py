"""Schemas (as DDL) and vocabularies of the field-analytics tables. Nothing is inferred; a missing value is NULL."""

from __future__ import annotations

ARCHITECTURES = ("gyroid", "diamond", "primitive")
GRADINGS = ("uniform", "linear", "sinusoidal")
SPLITS = ("train", "validation", "test")
NODE_KINDS = ("junction", "endpoint", "isolated", "synthetic_terminal")

DESIGN = (
    "sample_id string, architecture string, target_relative_density double, cell_size_mm double, grading_mode string, "
    "grading_amplitude double, phase_x_rad double, phase_y_rad double, phase_z_rad double, iid_split string"
)
NODES = ("sample_id string, node bigint, x double, y double, z double, kind string, region_voxels bigint")
EDGES = (
    "sample_id string, source bigint, target bigint, path_length double, chord_length double, tortuosity double, "
    "azimuth double, polar double, local_thickness_mean double, local_thickness_min double, voxel_count bigint"
)
METADATA = (
    "sample_id string, architecture string, iid_split string, solver_completed boolean, checkpoint_verified boolean, "
    "mesh_cfg struct<minratio: double, mindihedral: double, steinerleft: bigint>, authorized_targets array<string>"
)
PREDICTIONS = ("model string, sample_id string, node bigint, target string, y_true double, y_pred double")
