"""Column helpers: time windows, stay intervals, measures and text."""
