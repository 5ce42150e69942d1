"""Query trees: parsing, building, simplifying and ordering, all on the driver."""
