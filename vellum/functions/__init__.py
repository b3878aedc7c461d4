"""Part of vellum; see the README for the map of the package."""
