"""Readers and writers: nested publications, tables, lookups, TEI, harvested records, reports."""
