"""limnos: a Spark-native analytics engine for water data and text corpora."""
