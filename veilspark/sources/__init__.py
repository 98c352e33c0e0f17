"""Readers and writers: tables, directories of files, result / findings / audit sinks."""
