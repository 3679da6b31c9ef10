"""DataFrame -> DataFrame operators; compose them with ``df.transform``."""
