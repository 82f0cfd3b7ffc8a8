"""Spindle operators."""
