"""Language scanners that turn one file into code units."""
