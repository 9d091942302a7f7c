"""Analytics over large collections of small labelled graphs, and over training-data tables, in PySpark."""
