"""Scans of lists, catalogs and file trees, text extraction, and sinks."""
