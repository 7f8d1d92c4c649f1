"""Gene-content and gene-order analytics as declarative Spark plans."""
