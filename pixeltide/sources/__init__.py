"""Reading and writing the raw and the clean log."""
