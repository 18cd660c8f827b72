"""Readers and writers of sequence, alignment and model formats."""
