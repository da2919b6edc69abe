"""Spark-native analytics over 3D scene, trajectory and run tables."""
