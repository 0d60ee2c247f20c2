"""strataline: code intelligence, hybrid retrieval and corpus preparation as Spark plans."""
