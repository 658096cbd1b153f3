"""Reading and writing of observation tables."""
