"""Sources and stores: files, tables inside files, page layouts, workspace snapshots, stored tables."""
