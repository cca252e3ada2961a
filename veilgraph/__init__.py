"""veilgraph: derivation-aware disclosure analytics as Spark plans."""
