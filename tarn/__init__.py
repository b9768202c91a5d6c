"""tarn: a PySpark-native analytics engine for crawl data."""
