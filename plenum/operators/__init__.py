"""Pure ``DataFrame -> DataFrame`` operators; time and viewer are always parameters."""
