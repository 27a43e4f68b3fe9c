"""vecloom: vector collections, change feeds and corpus operators as Spark plans."""
