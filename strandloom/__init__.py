"""strandloom: pangenome analytics expressed as Spark DataFrame plans."""
