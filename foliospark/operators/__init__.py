"""DataFrame operators over documents."""
