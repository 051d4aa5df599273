"""Column functions: alleles, coordinates, consequences, frequencies, packed entries."""
