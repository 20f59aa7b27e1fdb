"""Training-data operators on the text tables; nothing else in ohmflow imports this subpackage."""
