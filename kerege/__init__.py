"""kerege: invoice validation and corpus preparation as Spark plans."""
