"""Plans: the whole pipeline, its command line, displays, and the driver's queries."""
