"""notelake: a PySpark-native analytics engine for knowledge bases made of plain files."""
