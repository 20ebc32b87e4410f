"""Find, reconcile and remove repeated or inserted spans in large corpora, as Spark DataFrame plans."""
