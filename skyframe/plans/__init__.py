"""Plans that put operators together, and what they need to run on a cluster."""
