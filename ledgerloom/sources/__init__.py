"""Readers of stored pages, API replies, listings and attachments."""
