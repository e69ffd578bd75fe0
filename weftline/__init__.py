"""weftline: a PySpark-native engine that profiles machine-to-machine network traffic."""
