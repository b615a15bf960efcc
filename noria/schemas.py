"""Explicit schemas of the corpus tables. A missing column reads as null; defaults come in by coalesce."""

from __future__ import annotations

WORD = "struct<word: string, diac: string, start: double, end: double>"
CUT = "struct<cut_frame: int, word_idx: int, stitch_row: bigint, stitch_len: int>"
RAW_METADATA = "id string, audio_path string, duration double, text string, confidence double, promo boolean"
MANIFEST = "id string, audio string, duration double, split string, text string, raw_text string, confidence double"
DIACRITIZED = "id string, diac string"
ALIGNED = f"id string, audio string, duration double, split string, text string, words array<{WORD}>, ctc_score double, timed_ratio double"
CACHE_INDEX = f"id string, offset bigint, frames int, duration double, words array<{WORD}>, cuts array<{CUT}>"
LATENTS = "utt_id string, frame int, latent array<float>"
STITCH = "stitch_row bigint, k int, latent array<float>"
SCALARS = "run string, tag string, step bigint, value double"
