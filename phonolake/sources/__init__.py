"""Reading and writing of resource tables."""
