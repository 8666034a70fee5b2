"""Readers of corpus folders and chat exports, all to the same exchange and message tables."""
