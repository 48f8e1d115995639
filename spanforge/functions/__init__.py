"""Part of spanforge; see README."""
