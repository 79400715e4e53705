"""newsloom: article-corpus analytics written as Spark DataFrame plans."""
