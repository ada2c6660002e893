"""codequarry: semantic code-index analytics expressed as Spark plans."""
