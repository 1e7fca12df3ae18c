"""Chunk planning: sections to chunks."""
