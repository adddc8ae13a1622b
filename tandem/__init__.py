"""tandem: PySpark-native parity analytics over two deployments of one pipeline."""
