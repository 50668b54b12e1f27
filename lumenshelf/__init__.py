"""lumenshelf: catalogue analytics and corpus preparation as Spark plans."""
