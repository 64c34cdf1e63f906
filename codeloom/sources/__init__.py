"""Sources and sinks: source trees, commit logs, snapshots, and the index built from them."""
