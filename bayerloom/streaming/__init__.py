"""The order-dependent transforms on streams, with their state in Spark's state store."""

from .stateful import stream_average, stream_pairs

__all__ = ["stream_average", "stream_pairs"]
