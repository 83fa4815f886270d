"""lakeloom: Spark-native customer analytics, bank-product lookups and retrieval data."""
