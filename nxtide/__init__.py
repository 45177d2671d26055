"""DNS-traffic analytics as Spark plans."""
