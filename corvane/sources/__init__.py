"""Scans and adapters: files, lines, symbols, commits and other tables the operators read."""
