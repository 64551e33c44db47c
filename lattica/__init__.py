"""A property-graph analytics engine made of Spark DataFrame plans."""
