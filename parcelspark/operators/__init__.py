"""DataFrame -> DataFrame operators: cleaning, aggregates, geocoding, spatial joins, summary, serving."""
