"""lakewarden: data-conformance rules compiled to Spark plans."""
