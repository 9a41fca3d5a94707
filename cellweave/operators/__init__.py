"""DataFrame operators over cell, point, tile, document and run-log tables."""
