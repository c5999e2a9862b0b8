"""Adapters from plain tables to fact contracts, and the registered queries."""
