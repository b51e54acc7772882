"""Training-data operators: cleaning, matching, scoring and mixing of a text corpus on Spark."""
