"""strandframe: genomic-locus and sequence analytics as PySpark DataFrame operators."""
