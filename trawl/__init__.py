"""Part of the trawl engine."""
