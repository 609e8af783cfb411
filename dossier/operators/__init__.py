"""DataFrame-to-DataFrame transformations, one module per subject."""
