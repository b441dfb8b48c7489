"""DataFrame -> DataFrame steps of the news pipeline."""
