"""Readers and writers: raw pages, captured maps, exports."""
