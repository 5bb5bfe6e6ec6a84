"""Watermarks, keyed state and streaming writers."""
