"""Writers for tables, GeoJSON layers, JSON documents and the versioned link table."""
