"""DataFrame -> DataFrame operators; each module covers one step of the analysis."""
