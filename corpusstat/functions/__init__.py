"""Part of corpusstat."""
