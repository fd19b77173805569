"""A PySpark-native analytics engine over catalogued tables and flow edges."""
