"""helixlake operators."""
