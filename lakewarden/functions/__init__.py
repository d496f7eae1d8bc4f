"""Part of lakewarden."""
