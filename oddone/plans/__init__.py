"""End-to-end plans: the reference's experiments re-expressed as DataFrame pipelines."""
