"""Spindle functions."""
