"""DataFrame operators: raster, joins, spectral fits, selection, diagnostics and sinks."""
