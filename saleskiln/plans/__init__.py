"""Stored tables: contracts, lazy builds, and the runs that write them."""
