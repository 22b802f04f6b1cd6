"""Spark-first text analytics: lines, search, counting, replacement, chunking, segmentation, checksums."""
