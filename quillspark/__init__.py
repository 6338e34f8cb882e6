"""quillspark: a Spark-first engine for collections of scholarly Markdown notes and their citations."""
