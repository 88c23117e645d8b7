"""Training-data operators over text tables; nothing outside this package imports it."""
