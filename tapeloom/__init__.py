"""tapeloom: market-tape analytics and data processing as Spark plans."""
