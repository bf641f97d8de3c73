"""Readers: raw blobs, raw directories, DNG sequences, zstd blobs, TCP streams, and a replay in place of a camera."""

from .dng import parse_dng, read_dng
from .raw import BlobSource, read_blob, read_directory, read_zstd
from .tcp import TcpSource, read_tcp, replay

__all__ = ["BlobSource", "TcpSource", "parse_dng", "read_blob", "read_directory", "read_dng", "read_tcp", "read_zstd", "replay"]
