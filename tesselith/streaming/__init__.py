"""Streaming of tesselith."""
