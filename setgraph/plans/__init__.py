"""Plan-level helpers: lineage, partition counts, size guards."""
