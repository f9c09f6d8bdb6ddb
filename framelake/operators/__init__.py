"""Operators over frame, scene, detection, face and track tables: DataFrame in, DataFrame out."""
