"""Readers and writers: report files, messages, tables."""
