"""The engine's queries over the star-schema and event tables, with their SQL oracles."""
