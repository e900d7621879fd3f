"""Part of the tessella package; see README.md."""
