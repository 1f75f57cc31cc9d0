"""DataFrame to DataFrame operators; columns are always passed by name."""
