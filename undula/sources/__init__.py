"""Readers and writers of panels, attribute tables and event lists."""
