"""Planning a target schema from a source catalog and rules: plain Python on the driver."""
