"""Streaming form of the stateless answer plan (the reference has no streaming operators;
its cleaning, matching and prompt steps are plain column expressions and run unchanged here)."""
