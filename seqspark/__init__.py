"""PySpark-native exact local sequence alignment and corpus analytics."""
