"""brindle: listings curation, matching and search, and corpus preparation, as DataFrame programs."""
