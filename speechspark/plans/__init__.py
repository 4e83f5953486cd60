"""Registered queries, the fixtures they read and their check SQL."""
