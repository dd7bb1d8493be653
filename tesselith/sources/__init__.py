"""Sources of tesselith."""
