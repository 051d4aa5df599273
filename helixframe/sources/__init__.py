"""Readers and writers: variant files, block gzip, reference sequences, the feature cache."""
