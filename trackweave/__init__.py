"""Track, motif and triplet analytics written as Spark DataFrame jobs."""
