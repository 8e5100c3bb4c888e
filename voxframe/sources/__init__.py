"""Readers and writers of pages, tables and exports."""
