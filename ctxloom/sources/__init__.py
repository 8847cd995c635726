"""Sources and sinks: trees, diffs, configs, memory, bundles and embeddings."""
