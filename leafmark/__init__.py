"""Part of leafmark, a Spark-native document analytics library."""
