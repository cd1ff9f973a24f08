"""Sources: schemas, discovery on a file system, the catalogue of tables, intermediate tables."""
