"""Volumetric feature analytics on Spark: voxel tables in, feature tables out."""
