"""Left empty on purpose: every job here is a batch job over stored position reports."""
