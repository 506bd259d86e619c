"""DataFrame operators over the attribution model, computed for all keys at once."""
