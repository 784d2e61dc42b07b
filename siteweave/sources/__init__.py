"""Readers: stored pages, HTML, JSON-LD, robots files and sitemaps."""
