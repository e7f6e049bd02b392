"""Building blocks that keep every operator safe for a recording that holds a large share of all rows."""
