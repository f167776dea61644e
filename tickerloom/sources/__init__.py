"""Readers, writers and the stage manifest."""
