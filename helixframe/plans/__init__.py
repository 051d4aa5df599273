"""Registered queries over the driver's tables, with their oracle SQL."""
