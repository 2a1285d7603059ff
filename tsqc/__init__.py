"""PySpark-native quality control of sensor time series."""
