"""Codecs and views: packed frames to pixels and back, frame rows to numpy arrays and back."""
