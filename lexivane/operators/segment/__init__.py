"""Chinese word segmentation and keyword extraction."""
