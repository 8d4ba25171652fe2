"""Plenum: PySpark-native operators for meeting and collaboration data."""
