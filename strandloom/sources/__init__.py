"""Readers and writers: FASTA, GFA, GFF3, presence/absence tables, Newick."""
