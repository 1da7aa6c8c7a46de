"""Lociform: a Spark-native engine for genomic, omics and text tables."""
