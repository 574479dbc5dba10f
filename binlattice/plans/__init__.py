"""Join and annotation helpers that several operators plan with."""
