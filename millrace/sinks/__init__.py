"""Writers for what a script's LOAD INTO can name."""
