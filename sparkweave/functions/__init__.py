"""Part of the record-linkage engine."""
