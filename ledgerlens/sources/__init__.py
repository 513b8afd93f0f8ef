"""Sources and sinks: pruned contract scan, test-table adapter, dataset
fingerprint, snapshot store and prioritised CSV export."""
