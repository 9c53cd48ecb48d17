"""Column functions: integer codes, colour, lane arithmetic and border policies."""
