"""Operators: checksums, annotations, RDF mapping, integrity checks."""
