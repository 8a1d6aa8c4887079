"""Sources: scans of rasters, tiles, meshes and results, and synthetic fields."""
