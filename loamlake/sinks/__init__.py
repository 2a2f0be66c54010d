"""Writers: versioned tables, corpus shards, manifests and catalogue documents."""
