"""loomtext: ranking, packing and summarising of text and source-tree corpora on Spark."""
