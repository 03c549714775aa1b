"""Reading and writing the library's files."""
