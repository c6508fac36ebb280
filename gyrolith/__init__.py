"""Gyrolith: clustering, raster-mask analytics and training-data operators as Spark jobs."""
