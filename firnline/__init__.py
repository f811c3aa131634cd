"""firnline: altimetry point clouds, grids and cubes as Spark DataFrame operators."""
