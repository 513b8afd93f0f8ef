"""Plans: the enrichment job (layer 1), views, facts and readings (layer 2),
the registry of named queries and their SQL oracles."""
