"""quillon: batch analytics over longitudinal records and training corpora, written for Spark."""
