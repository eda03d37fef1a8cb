"""LotLens: property-listing analytics expressed as Spark DataFrame programs."""
