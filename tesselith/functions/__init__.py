"""Functions of tesselith."""
