"""Training-corpus operators; nothing outside this folder imports it."""
