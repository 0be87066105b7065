"""Readers: registries, instrument configuration, file listings and raw instrument exports."""
