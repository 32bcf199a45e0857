"""helixlake streaming."""
