"""Importing this module registers every core query."""

from plyforge.plans import evidence, history, matches, mining, positions, rows, storage, transcripts  # noqa: F401
