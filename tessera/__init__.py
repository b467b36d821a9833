"""tessera: Spark-native analytics for tiled whole-slide image data."""
