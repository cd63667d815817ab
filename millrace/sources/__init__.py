"""Readers and writers of JSON lines, artefact folders and logs."""
