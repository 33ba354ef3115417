"""Readers and writers: GEDCOM text, Gramps XML, delimited gazetteers, lookup tables."""
