"""Registered queries and their SQL twins; see ``registry``."""
