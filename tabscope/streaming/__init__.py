"""Streaming adapters (see ``live``)."""
