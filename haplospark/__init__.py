"""PySpark-native engine for haplotype phasing tables."""
