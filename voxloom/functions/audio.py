"""Waveform helpers that run inside Arrow batches on the workers.

Spark splits and schedules the rows; each helper turns one waveform into one result.
"""

from __future__ import annotations

import io
import wave
from functools import lru_cache
from math import ceil, gcd

import numpy as np

from voxloom.config import N_CODEBOOKS, SAMPLE_RATE

# Low-pass width (zero crossings) and roll-off of the resampling filter.
LOWPASS_WIDTH = 6
ROLLOFF = 0.99

# Fixed value: samples per code frame, 12.5 frames per second at 24 kHz.
HOP = 1_920


class UnsupportedAudio(ValueError):
    """The audio cell cannot be turned into a waveform."""


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """PCM WAV bytes to ``([channels, n] in [-1, 1), rate)``."""
    try:
        with wave.open(io.BytesIO(data)) as src:
            channels, width, rate = src.getnchannels(), src.getsampwidth(), src.getframerate()
            raw = src.readframes(src.getnframes())
    except (wave.Error, EOFError) as exc:
        raise UnsupportedAudio("unsupported_container") from exc
    if width == 1:
        pcm = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        low_mid_high = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        value = low_mid_high @ np.array([1, 1 << 8, 1 << 16], np.int32)
        pcm = np.where(value >= 1 << 23, value - (1 << 24), value) / float(1 << 23)
    elif width in (2, 4):
        pcm = np.frombuffer(raw, f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
    else:
        raise UnsupportedAudio("unsupported_sample_width")
    return pcm.reshape(-1, channels).T, rate


def downmix(waveform: np.ndarray) -> np.ndarray:
    """``[channels, n]`` to mono ``[n]`` by the mean."""
    return waveform[0] if waveform.shape[0] == 1 else waveform.mean(axis=0)


@lru_cache(maxsize=64)
def _filter_bank(orig: int, new: int) -> tuple[np.ndarray, int]:
    """Windowed-sinc taps for each of the ``new`` output phases, and the taps' reach."""
    cutoff = min(orig, new) * ROLLOFF
    reach = ceil(LOWPASS_WIDTH * orig / cutoff)
    taps = np.arange(-reach, reach + orig)[:, None]
    distance = (taps / orig - np.arange(new)[None, :] / new) * cutoff
    window = np.cos(np.pi * distance / (2 * LOWPASS_WIDTH)) ** 2
    window[np.abs(distance) >= LOWPASS_WIDTH] = 0.0
    return np.sinc(distance) * window * (cutoff / orig), reach


def reduced_rates(orig_rate: int, new_rate: int) -> tuple[int, int]:
    """Both rates over their greatest common divisor."""
    if orig_rate <= 0:
        raise UnsupportedAudio("bad_sampling_rate")
    shared = gcd(orig_rate, new_rate)
    return orig_rate // shared, new_rate // shared


def filter_reach(orig_rate: int, new_rate: int) -> int:
    """Samples before and after a block that its filtering looks at."""
    return 0 if orig_rate == new_rate else _filter_bank(*reduced_rates(orig_rate, new_rate))[1]


def resample(mono: np.ndarray, orig_rate: int, new_rate: int) -> np.ndarray:
    """Band-limited resampling; the result has ``ceil(new / orig * n)`` samples."""
    orig, new = reduced_rates(orig_rate, new_rate)
    return resample_block(mono, 0, mono.size, orig_rate, new_rate)[: -(-new * mono.size // orig)]


def resample_block(piece: np.ndarray, before: int, n: int, orig_rate: int, new_rate: int) -> np.ndarray:
    """Resample ``n`` samples that ``piece`` holds after ``before`` samples of what lies in front of them.

    What ``piece`` lacks before and after them counts as silence. The block must start at a whole number of
    steps (``reduced_rates``) into its recording; there are outputs for the step that ``n`` ends in as well.
    """
    if orig_rate == new_rate or n == 0:
        return piece[before : before + n]
    orig, new = reduced_rates(orig_rate, new_rate)
    bank, reach = _filter_bank(orig, new)
    steps = n // orig + 1
    padded = np.zeros(steps * orig + bank.shape[0], dtype=np.float64)
    own = piece[max(0, before - reach) :][: padded.size]
    first = reach - min(before, reach)
    padded[first : first + own.size] = own[: padded.size - first]
    rows = np.lib.stride_tricks.sliding_window_view(padded, bank.shape[0])[: steps * orig : orig]
    return (rows @ bank).ravel()


class LatticeEncoder:
    """Residual vector quantisation with fixed codebooks, used unless a neural codec is plugged in.

    Each 1,920-sample frame is reduced to 16 block means. A codebook is a 45 x 45 lattice over
    one pair of means (2,025 codewords, below the 2,048 ids a codebook may use); 8 pairs times 4
    rounds make 32 codebooks, each round quantising what the round before left over.
    """

    LEVELS = 45
    BLOCKS = 16

    def __init__(self, n_codebooks: int = N_CODEBOOKS, hop: int = HOP):
        self.pairs = self.BLOCKS // 2
        if n_codebooks % self.pairs or hop % self.BLOCKS:
            raise ValueError("codebooks must be a multiple of 8 and the hop a multiple of 16")
        self.rounds = n_codebooks // self.pairs
        self.hop = hop

    def encode(self, mono: np.ndarray) -> np.ndarray:
        """Mono waveform to ``[n_codebooks, n_frames]``; the last frame is filled with silence."""
        frames = -(-mono.size // self.hop)
        padded = np.zeros(frames * self.hop, dtype=np.float64)
        padded[: mono.size] = mono
        means = padded.reshape(frames, self.BLOCKS, -1).mean(axis=2)
        left = np.clip((means + 1.0) / 2.0, 0.0, 1.0 - 2.0**-40)
        codes = []
        for _ in range(self.rounds):
            scaled = left * self.LEVELS
            digit = np.floor(scaled)
            left = scaled - digit
            codes.append(digit[:, 0::2] * self.LEVELS + digit[:, 1::2])
        return np.concatenate(codes, axis=1).T.astype(np.int32)


def decode(cell: dict, decoder=decode_wav) -> tuple[np.ndarray, int]:
    """An audio cell to ``([channels, n], rate)``. Decoded arrays win over container bytes."""
    if cell["array"] is not None:
        flat = np.asarray(cell["array"], dtype=np.float64)
        channels = cell["channels"] or 1
        if channels < 1 or flat.size % channels:
            raise UnsupportedAudio("bad_channel_count")
        return flat.reshape(channels, -1), cell["sampling_rate"] or 0
    if cell["bytes"] is not None:
        return decoder(cell["bytes"])
    raise UnsupportedAudio("no_audio")


def standardise(cell: dict, decoder=decode_wav, rate: int = SAMPLE_RATE) -> np.ndarray:
    """An audio cell to a mono waveform at ``rate``."""
    waveform, source_rate = decode(cell, decoder)
    return resample(downmix(waveform), source_rate, rate)
