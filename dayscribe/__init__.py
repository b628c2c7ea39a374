"""dayscribe: a PySpark-native engine for building and checking text corpora."""
