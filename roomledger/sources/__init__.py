"""Table schemas, loaders, seed rows and the star-schema mapping."""
