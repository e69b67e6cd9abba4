"""tessera: Spark-native analytics over tables of binary artifacts and text corpora."""
