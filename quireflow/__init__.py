"""quireflow: text analytics over manuscripts and corpora, expressed as lazy Spark DataFrames."""
