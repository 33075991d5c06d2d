"""Content-pipeline analytics on Spark: feeds to ranked, versioned news tables, as DataFrame transformations."""
