"""locusframe: a Spark-native analytics engine for genomic variant calls."""

VERSION = "0.2.0"
