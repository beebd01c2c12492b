"""Column functions: time, map projections, plane geometry, wave spectra."""
