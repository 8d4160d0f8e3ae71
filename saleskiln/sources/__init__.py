"""Landed pages, raw schemas, bronze rows and catalog tables."""
