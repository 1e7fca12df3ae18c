"""quireworks: table-level Spark jobs for chunking, indexing, citing and checking a text corpus."""
