"""Column functions: vectors, paths, tag names, hashes and boxes."""
