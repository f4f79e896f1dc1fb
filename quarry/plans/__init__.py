"""Plan helpers: table access, shared tables that cut lineage, connected components."""
