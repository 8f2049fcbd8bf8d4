"""DataFrame → DataFrame operators; column roles are arguments."""
