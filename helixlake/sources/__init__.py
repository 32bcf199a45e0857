"""helixlake sources."""
