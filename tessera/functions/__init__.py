"""Part of tessera; see the package README for the layout."""
