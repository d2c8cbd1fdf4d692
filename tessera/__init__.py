"""tessera: typed, weighted tables and their analysis, as DataFrame expressions."""
