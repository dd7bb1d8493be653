"""Llm of tesselith."""
