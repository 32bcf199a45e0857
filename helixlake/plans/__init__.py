"""helixlake plans."""
