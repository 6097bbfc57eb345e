"""Sources: discovery and reading of collections, and views of plain tables as collections."""
