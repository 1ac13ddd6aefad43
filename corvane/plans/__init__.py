"""Registered queries: operators bound to the star-schema tables, each with its SQL."""
