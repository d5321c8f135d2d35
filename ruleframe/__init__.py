"""A rule language with aggregating rules, compiled to Spark plans."""
