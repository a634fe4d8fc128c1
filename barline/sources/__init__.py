"""Readers and writers: archives, pages, bar tables, run logs and envelopes."""
