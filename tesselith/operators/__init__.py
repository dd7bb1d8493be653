"""Operators of tesselith."""
