"""Place resolution for genealogy data on Spark: files in, corrected files, hierarchy and review queue out."""
