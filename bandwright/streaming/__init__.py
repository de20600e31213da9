"""No streams: every job of this package is a batch job over stored tables (see README)."""
