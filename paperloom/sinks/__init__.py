"""Writing results: projections, guarded JSON, keyed upserts."""
