"""Strandloom: pangenome read analytics as DataFrame-to-DataFrame functions on PySpark."""
