"""Configuration, staged runs and publication of results."""
