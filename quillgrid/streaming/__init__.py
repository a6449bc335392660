"""Time windows and request dedupe, in batch and as streams."""
