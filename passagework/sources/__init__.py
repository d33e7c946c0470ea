"""Scans: files, stored web pages, prompt templates, driver tables."""
