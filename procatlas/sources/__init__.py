"""Readers, writers and normalisation of exports."""
