"""Turn tables of fetched web pages into clean, de-duplicated, ranked listing tables with Spark."""
