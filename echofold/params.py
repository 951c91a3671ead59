"""Parameters of matching, and the fixed geometry of the hashes."""

from __future__ import annotations

from dataclasses import dataclass

#: Stored hashes depend on them.
SAMPLE_W, SAMPLE_H, SAMPLE_BYTES, SAMPLE_FPS = 9, 8, 72, 6
AUDIO_SAMPLE_RATE, AUDIO_CHANNELS = 22050, 1
HASH_SIZE, ROW_STRIDE, GRAY_LEN, HASH_BYTES, NUM_CHUNKS = 16, 17, 272, 32, 16
#: The average of an alignment that did not match: the greatest 32-bit float.
NO_MATCH_AVG = 3.4028234663852886e38
#: The rank of an id that has none: the greatest 64-bit number.
NO_RANK = 18446744073709551615


@dataclass(frozen=True)
class DedupParams:
    """Thresholds are 32-bit floats, in average differing bits; floors are frames."""

    sample_window_secs: int = 60
    threshold_bits: float = 10.0
    #: Not used by the engine: below this, callers may take a visual match without other evidence.
    near_identical_visual_bits: float = 3.0
    motion_bits: int = 2
    min_overlap_frames: int = 30
    min_overlap_hard_floor: int = 30
    audio_threshold_bits: float = 3.0
    audio_min_overlap: int = 30
    audio_min_overlap_hard_floor: int = 30
