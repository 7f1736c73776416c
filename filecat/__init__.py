"""Analysis and maintenance of very large file catalogs as ordinary DataFrames."""
