"""Composites: what a page, a report or a refresh needs, planned together."""
