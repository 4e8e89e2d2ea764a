"""Directory trees as data: snapshots, change sets and their transport as Spark plans."""
