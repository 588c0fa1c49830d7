"""Formulaic factors on panel data, as ordinary Spark jobs."""
