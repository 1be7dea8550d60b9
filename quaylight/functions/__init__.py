"""Part of the quaylight engine; see README.md."""
