"""Column functions over residues, CIGAR strings and statistics."""
