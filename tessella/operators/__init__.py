"""DataFrame-to-DataFrame operators on grids, blocks and ordinary tables."""
