"""Plans over whole tables: adapters, pipelines and registered queries."""
