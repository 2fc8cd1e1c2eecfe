"""Sources: file trees, lockfiles, roots, change feeds and the driver-table fixtures."""
