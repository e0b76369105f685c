"""inkwell: a PySpark engine that prepares, queries and audits text corpora."""
