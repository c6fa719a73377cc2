"""Spark-native analytics for point catalogues, meshes and neighbours."""
