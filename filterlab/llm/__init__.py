"""Training-data operators. Nothing else in filterlab imports this subpackage."""
