"""Readers and writers: basket files, catalogues, processed tables, test tables."""
