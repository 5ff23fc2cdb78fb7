"""tessera: lexical search, search analytics and corpus operators as Spark plans."""
