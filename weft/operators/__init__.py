"""Graph storage, traversals, searches and writes over DataFrames."""
