"""Column builders: no DataFrame is read or shuffled here."""
