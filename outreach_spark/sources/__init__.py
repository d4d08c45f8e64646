"""Sources: landed-table adapters, scans and catalogue / payload readers."""
