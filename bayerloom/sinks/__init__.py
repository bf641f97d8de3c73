"""Writers: raw blobs, raw directories, DNG sequences, encoder pipes, and the benchmark."""

from .benchmark import benchmark, plot_range, stream_rate
from .dng import FrameServer, dng_bytes, frame_as_dng, read_profile, write_dng
from .preview import preview
from .raw import write_blob, write_directory, write_encoder

__all__ = ["FrameServer", "benchmark", "dng_bytes", "frame_as_dng", "plot_range", "preview", "read_profile", "stream_rate", "write_blob", "write_directory", "write_dng", "write_encoder"]
