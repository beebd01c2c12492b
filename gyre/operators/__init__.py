"""DataFrame operators on fields, meshes, grids, time series and moving points."""
