"""The transforms, in pixel form: DataFrames of (frame_no, y, x, v) or (frame_no, y, x, r, g, b).

``bayerloom.kernels`` has the same transforms for whole packed frames; tests hold the two equal.
"""

from .averaging import average, count_windows
from .color import color_voodoo
from .dark import darkframe_subtract
from .debayer import debayer, debayer_half
from .depth import bit_depth, fp32_to_u16
from .dual import decode_pairs, pair_halves, split_rows
from .histogram import histogram, plot_trim
from .lut import Cube, apply_cube, parse_cube
from .rownoise import MODELS, RowNoiseModel, green_medians, load_model, pair_lag, remove_row_noise, train_model, training_sums
from .selecting import internal_loop, number_of_frames, sequence_gaps, split, swap_red_blue

__all__ = [
    "MODELS", "Cube", "RowNoiseModel", "apply_cube", "average", "bit_depth", "color_voodoo", "count_windows", "darkframe_subtract",
    "debayer", "debayer_half", "decode_pairs", "fp32_to_u16", "green_medians", "histogram", "internal_loop", "load_model",
    "number_of_frames", "pair_halves", "pair_lag", "parse_cube", "plot_trim", "remove_row_noise", "sequence_gaps", "split", "split_rows", "swap_red_blue", "train_model", "training_sums",
]
