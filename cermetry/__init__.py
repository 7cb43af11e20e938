"""cermetry: composite-materials analytics expressed as Spark DataFrame jobs."""
