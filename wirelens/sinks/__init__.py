"""Writers: snapshots, keyed tables, exchange objects, outboxes, retention."""
