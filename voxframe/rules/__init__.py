"""Default rule tables: plain data, all of it overridable."""
