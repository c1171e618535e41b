from .profile import append_batch_counts, read_counts, stream_value_freq
from .recipe import check_streaming_safe, dedup_within, stream_recipe

__all__ = [
    "append_batch_counts",
    "check_streaming_safe",
    "dedup_within",
    "read_counts",
    "stream_recipe",
    "stream_value_freq",
]
